"""Ledger operators over DataFrames of accounts, transfers and events."""
