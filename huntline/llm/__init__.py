"""Operators of a training-data pipeline: filtering, de-duplication, mixing, sharding, scoring, tokens."""
