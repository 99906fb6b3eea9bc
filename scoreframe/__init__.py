"""Rating, nomination and measurement analytics as Spark DataFrame jobs."""
