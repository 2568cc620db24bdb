"""A Spark-native engine for analysing, tokenising and losslessly coding URLs and other short texts."""
