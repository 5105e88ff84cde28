"""Label compliance audits and training-data operators as Spark jobs."""
