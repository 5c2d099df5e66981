"""Operators composed into the runs a user starts."""
