"""Wayfinder: graph-enhanced retrieval and itinerary analytics on Spark DataFrames."""
