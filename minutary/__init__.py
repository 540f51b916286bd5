"""Minutes from meeting transcripts, as Spark DataFrame jobs."""
