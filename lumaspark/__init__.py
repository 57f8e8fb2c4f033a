"""Media-library analytics on Spark: catalogue, vectors, search, map layout, navigation."""
