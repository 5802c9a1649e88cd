"""loomwork: a PySpark-native text-analytics engine."""
