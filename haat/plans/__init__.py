"""Query plans: the named queries the driver runs (``registry``) and their
DuckDB oracle SQL (``oracle``)."""
