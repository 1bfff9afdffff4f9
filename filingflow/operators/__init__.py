"""Operators over DataFrames of filings, units, batches and answers."""
