"""Score candidate SQL queries on labelled tables and prepare the text around them, as Spark jobs."""
