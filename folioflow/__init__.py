"""folioflow: a PySpark-native engine for document-extraction pipelines."""
