"""voxloom: Spark-native preparation and analysis of text and speech corpora."""
