"""lathework: tabular analytics and feature processing as Spark DataFrame jobs."""
