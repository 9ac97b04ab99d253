"""folioscope: a PySpark-native engine for paper metadata, ordinal scoring and corpus preparation."""
