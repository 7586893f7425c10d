"""Ratings, consensus pricing and reporting for quoted paired contests, as Spark jobs."""
