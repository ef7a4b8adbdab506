"""Tables: their schemas, catalog entries, loads and files."""
