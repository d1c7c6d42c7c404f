"""PySpark-native process control analytics over many ordered series."""
