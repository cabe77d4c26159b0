"""Query plans over the driver's tables: derived inputs, the query
catalogue and the DuckDB SQL twins used as correctness oracle."""
