"""Inputs derived from the driver's tables and the SQL the results are compared with."""
