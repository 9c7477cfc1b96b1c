"""Point-in-time analytics of paired contests on Spark."""
