"""Operators of a training-data pipeline: tokenising, filters, dedup, sharding and archives."""
