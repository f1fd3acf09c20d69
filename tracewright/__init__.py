"""Log analytics on Spark: load logs, enrich events and sequences, find anomalies."""
