"""askwell: retrieval question-answering data work as plain Spark jobs."""
