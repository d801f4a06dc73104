"""Analytics for legal text and training data, on Spark."""
