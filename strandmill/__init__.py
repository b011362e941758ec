"""A PySpark-native engine for finding recurring work in large message archives."""
