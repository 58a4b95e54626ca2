"""Document search and analytics as Spark DataFrame plans."""
