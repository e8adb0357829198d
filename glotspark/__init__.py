"""glotspark: Spark-native analytics for multilingual text corpora."""
