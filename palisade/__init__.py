"""Screening of package corpora on Spark."""
