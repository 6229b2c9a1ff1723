"""quarrymill: a PySpark-native engine for stored web pages, extraction records and pipeline logs."""
