"""Dialogue-state analytics and training-data preparation as Spark programs."""
