"""bytelens: a PySpark-native engine for analysing compiled bytecode as data."""
