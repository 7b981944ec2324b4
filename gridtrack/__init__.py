"""gridtrack: features in gridded fields and their tracks, on Spark."""
