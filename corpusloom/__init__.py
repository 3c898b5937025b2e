"""A PySpark-native content-ingestion and analytics engine."""
