"""Security-log analytics and training-data preparation as Spark jobs."""
