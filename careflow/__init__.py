"""PySpark-native analytics for a clinical care unit."""
