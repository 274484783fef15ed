"""A Spark-native engine for syncing records from many sources into one store and answering operational questions about it."""
