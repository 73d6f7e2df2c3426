"""Declarative document mapping on Spark DataFrames."""

from mapweave.errors import ConfigValidationError, MappingError
from mapweave.plans.mapping import Mapping

__all__ = ["ConfigValidationError", "Mapping", "MappingError"]
