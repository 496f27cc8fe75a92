"""Trajectory analytics and point-of-interest recommendation as Spark DataFrame jobs."""
