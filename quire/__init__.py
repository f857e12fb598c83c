"""quire: a PySpark-native engine for preparing, checking and assembling text corpora."""
