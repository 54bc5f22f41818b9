"""Corpus operators for training-data pipelines (stands alone; nothing else imports it)."""
