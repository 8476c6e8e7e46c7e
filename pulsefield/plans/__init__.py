"""The catalogue of queries, their DuckDB SQL, and lineage control."""
