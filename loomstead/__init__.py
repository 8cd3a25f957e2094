"""loomstead: typed catalogs, document indexes and lineage derivation as Spark DataFrames."""

__version__ = "0.1.0"
