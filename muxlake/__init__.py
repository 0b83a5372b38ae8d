"""muxlake: Spark-native analytics over transport-media streams."""
