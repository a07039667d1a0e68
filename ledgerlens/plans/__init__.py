"""Plans: the named analyses and dashboard datasets, the query registry and its
DuckDB twins, the build path and the SQL path."""
