"""Stratified transcript-evaluation analytics on Spark."""
