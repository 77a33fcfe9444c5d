"""gleaner: a PySpark-native analytics engine for job-posting tables."""
