"""Ready-made queries over the adapted tables, and the SQL they equal."""
