"""Corpus operators for training-data pipelines: dedup, scans, packing, sharding, decontamination."""
