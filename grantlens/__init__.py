"""Eligibility, evidence and question analytics for education grants, as Spark jobs."""
