"""Text-table curation and run analytics as PySpark DataFrame jobs."""
