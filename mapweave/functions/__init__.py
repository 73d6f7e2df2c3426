"""The builtin function library."""
