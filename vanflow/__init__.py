"""Route-sales demand and order analytics expressed as Spark DataFrame jobs."""
