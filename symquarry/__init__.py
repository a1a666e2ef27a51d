"""symquarry: a PySpark-native engine for indexing and querying source-code corpora."""
