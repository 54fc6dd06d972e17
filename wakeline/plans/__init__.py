"""Whole runs: ingestion and trajectories, their receipts, and the registered queries."""
