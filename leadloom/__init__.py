"""Site-lead analytics and training-data operators on Spark."""
