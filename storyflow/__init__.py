"""PySpark-native operators for serialized web text."""
