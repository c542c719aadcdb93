"""ringledger: a PySpark-native analytics engine for entity histories and head-to-head contests."""
