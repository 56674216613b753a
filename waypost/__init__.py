"""Waypost: place analytics and corpus preparation written as Spark jobs."""
