"""A Spark-native table engine: schema-checked scans, an ordered key-value table and a log-structured table."""
