"""PySpark-native engine for record-level cohort analytics."""
