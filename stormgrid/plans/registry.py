"""All queries over the driver tables and their SQL; importing the modules registers them."""

from __future__ import annotations

from . import fields, inference, regional, storms  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
