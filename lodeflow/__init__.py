"""lodeflow: a Spark-native engine for curating noisily labelled datasets."""
