"""Spark-native analytics over reference-mapped sequences: distances, neighbours, clusters, alignments and trends."""
