"""Sources: trees of files, XML logs, element-per-line text; and sinks for tables."""
