"""Named queries over the driver tables; importing the modules fills the registry."""

from . import access, catalog, dml, lifecycle, lineage, metrics, quality, storage, streaming, views  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
