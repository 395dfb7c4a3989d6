"""Point-in-time analytics of contests and predictions on Spark."""
