"""Web-page extraction, CSV, prompt and trial analytics as Spark DataFrame jobs."""
