"""Vessel-track analytics expressed as Spark DataFrame programs."""
