"""Filings analytics on Spark."""
