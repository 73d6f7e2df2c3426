"""Coded errors."""

from __future__ import annotations


class ConfigValidationError(ValueError):
    """The configuration document breaks the structural rules, or a schema can't be loaded."""


class MappingError(ValueError):
    """A coded diagnostic: code, message, JSON pointer and details."""

    def __init__(self, code: str, message: str, pointer: str = "", details: dict | None = None):
        super().__init__(f"{code} at {pointer or '/'}: {message}")
        self.code, self.message, self.pointer, self.details = code, message, pointer, details or {}
