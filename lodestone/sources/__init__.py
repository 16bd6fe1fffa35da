"""Sources and sinks."""

from lodestone.sources.tables import TABLES, table

__all__ = ["TABLES", "table"]
