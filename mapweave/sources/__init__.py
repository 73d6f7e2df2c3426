"""Readers of configurations, schemas and payloads; writers of results."""
