"""lakesift: Spark-native risk, provenance and policy analytics over text bundles."""
