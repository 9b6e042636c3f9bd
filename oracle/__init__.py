"""DuckDB statements that state independently what each registered query must return."""
