"""DuckDB statements the registered queries are checked against."""
