"""Hospital operations warehouse and analytics as PySpark DataFrame jobs."""
