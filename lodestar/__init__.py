"""A PySpark-native Parquet scan and analytics engine."""
