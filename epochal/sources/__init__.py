"""Layer tables, text sources, table reading."""
