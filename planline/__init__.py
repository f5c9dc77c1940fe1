"""planline: analytics over drawing-derived spatial entities, on Spark."""
