"""Evidence-tracked analytics expressed as Spark DataFrame, SQL and streaming operations."""
