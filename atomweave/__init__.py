"""atomweave: a PySpark-native engine for sets of s-expression facts and rewrite rules."""
