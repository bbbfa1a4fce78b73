"""Applicant-risk analytics on Spark: labels, features, encoders, scores, rules and decisions as DataFrame operators."""

__all__ = ["functions", "operators", "plans", "session", "sources", "streaming"]
