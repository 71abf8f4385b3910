"""Query plans: compositions of operators over the given tables, plus their
independent DuckDB SQL oracles."""
