"""PySpark-native analytics over test-suite inventories and their security evidence."""
