"""plinth: building-model graph analytics as Spark DataFrame jobs."""
