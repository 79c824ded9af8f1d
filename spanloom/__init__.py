"""spanloom: a PySpark-native engine for multimodal instruction data."""
