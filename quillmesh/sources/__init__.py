"""Sources and sinks: landed files in, tables and files out."""
