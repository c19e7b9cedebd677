"""A Spark-native dataframe analytics engine."""
