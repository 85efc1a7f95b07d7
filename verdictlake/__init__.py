"""Spark jobs that plan, score, store and analyse evaluations of text-generation models."""
