"""Writers for tables, logs and chunk files."""
