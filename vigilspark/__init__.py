"""Vigilspark: change-security analytics and corpus preparation as Spark jobs."""
