"""Operators of a training-data pipeline: scans, scores, near-duplicate joins, packing, mixing, output."""
