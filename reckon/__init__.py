"""Ledger reconciliation, settlement checks and merchant reporting on Spark DataFrames."""
