"""Point-in-time analytics over event, score and price histories, as Spark plans."""
