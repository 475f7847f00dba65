"""The SQL dialect, statements and the registered queries."""
