"""Importing this package registers every model, upstream ones first."""

from . import staging, intermediate, marts, operations, consumers  # noqa: F401,I001
from .consumers import CONSUMERS
from .warehouse import MODELS, Check, MissingTable, Model, Warehouse, downstream_models

__all__ = [
    "CONSUMERS",
    "MODELS",
    "Check",
    "MissingTable",
    "Model",
    "Warehouse",
    "downstream_models",
]
