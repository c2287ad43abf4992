"""A Spark-native engine for versioned changelogs and benchmark-run logs."""
