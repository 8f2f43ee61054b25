"""Spark-first analytics engine: leak-free event features, as-of joins, closed-form models and training-data preparation."""
