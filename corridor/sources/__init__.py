"""Reading and writing: tables, routes, lines and their sinks."""
