"""Mappings over streams of payloads."""
