"""linkspark: a PySpark-native engine for record linkage and metadata analytics."""
