"""Operators of a training-data pipeline: cleaning, deduplication, scoring, packing and archiving of text corpora."""
