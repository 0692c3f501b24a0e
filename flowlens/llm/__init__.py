"""Operators for training-data pipelines; nothing else in flowlens imports them."""
