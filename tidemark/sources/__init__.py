"""Readers, writers and adapters that make bars of trades."""
