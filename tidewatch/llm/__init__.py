"""Training-data operators: each a DataFrame-to-DataFrame function that runs on Spark."""
