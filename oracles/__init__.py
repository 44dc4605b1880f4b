"""The queries in DuckDB SQL, written independently of the Spark jobs."""
