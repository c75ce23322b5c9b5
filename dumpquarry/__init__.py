"""PySpark-native engine for relational database dumps."""
