"""Sources and sinks of cell tables."""
