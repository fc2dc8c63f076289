"""countloom: reconciliation, series, statistics and streaming operators for counts, on PySpark."""
