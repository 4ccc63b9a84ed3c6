"""Sources (tables, artifacts, stand-in derivations) and sinks."""

from tidemark.sources.tables import load_table  # noqa: F401
