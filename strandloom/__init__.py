"""strandloom: a PySpark-native engine for single-cell read pile-ups, clustering and variant calling."""
