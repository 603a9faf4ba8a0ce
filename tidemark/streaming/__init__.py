"""Ledger semantics on streams. Every sink can replay an epoch without doubling it."""
