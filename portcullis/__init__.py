"""Governance analytics over recorded AI traffic, written as Spark DataFrame jobs."""
