"""tessera: a PySpark-native analytics engine for dense numeric data."""
