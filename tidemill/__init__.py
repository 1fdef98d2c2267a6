"""Tidemill: DataFrame, SQL and Structured Streaming jobs over streams of short, messy, multilingual posts."""
