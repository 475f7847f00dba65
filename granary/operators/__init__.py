"""Changes of tables, constraint checks and transactions."""
