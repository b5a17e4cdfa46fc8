"""Operator chains: raw tables to features, models and decision tables."""
