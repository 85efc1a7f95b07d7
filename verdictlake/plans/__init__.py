"""Operators composed into the jobs a user runs end to end."""
