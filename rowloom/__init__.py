"""Row enrichment, retrieval and grading of tables as Spark DataFrame operators."""
