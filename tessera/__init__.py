"""tessera: a Spark-native text and entity analytics engine."""
