"""Invoice text to purchasing and accounting tables, as Spark jobs."""
