"""Sources and sinks: driver tables, the transaction adapter, files."""
