"""A Spark-native data store, query builder and set of columnar operators."""
