"""Registered queries with their SQL, and batch jobs."""
