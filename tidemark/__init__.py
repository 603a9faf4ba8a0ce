"""Versioned change ledger and table evolution for lakehouse tables on Spark."""
