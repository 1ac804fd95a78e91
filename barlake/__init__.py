"""barlake: Spark-native analytics over price bars, events and text."""
