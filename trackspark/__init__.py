"""PySpark-native analytics for time-stamped position tracks."""
