"""Operators for training-data pipelines: extraction, scoring, deduplication, decontamination and mixing."""
