"""Flight-delay and inventory analytics expressed as PySpark DataFrame jobs."""
