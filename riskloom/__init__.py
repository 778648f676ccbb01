"""Counterparty-risk tables and training-data jobs as Spark DataFrame programs."""
