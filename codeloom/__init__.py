"""codeloom: a Spark-native analytics engine for code intelligence."""
