"""Whole plans: ingest, ask, evaluate."""
