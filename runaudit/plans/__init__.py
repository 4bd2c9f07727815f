"""Audit questions, the incident report, building and grading."""
