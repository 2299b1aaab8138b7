"""Whole plans: walk-forward backtests, and the registered queries with their SQL."""
