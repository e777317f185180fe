"""Spatial-graph analytics and training-data operators as Spark DataFrame plans."""
