"""millrace: posting pipelines and corpus jobs as plain Spark DataFrame work."""
