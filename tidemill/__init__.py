"""tidemill: a Spark-native engine for collected news articles and text corpora."""
