"""A PySpark-native engine for networks of records that evolve over logical time."""
