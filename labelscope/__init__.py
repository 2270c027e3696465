"""Label-declaration extraction and compliance analytics as Spark jobs."""
