"""Document-knowledge and recall analytics as PySpark DataFrame jobs."""
