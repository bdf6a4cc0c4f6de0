"""Ledger validation and reconciliation on Spark DataFrames."""
