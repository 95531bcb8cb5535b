"""causeway: execution forensics and data preparation as PySpark DataFrame jobs."""
