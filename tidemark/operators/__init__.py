"""Keyed DataFrame operators: each takes keys and an order column where a plant has one implicit series."""
