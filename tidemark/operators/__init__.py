"""Cleaning, features, star schema, risk, checks and regimes."""
