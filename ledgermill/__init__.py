"""Accounts-receivable risk analytics as Spark DataFrame jobs.

Every public function takes and returns DataFrames (or column expressions) and stays
lazy, so callers compose them into one plan and let the optimizer do the rest.
"""
