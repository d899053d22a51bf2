"""Operators for training data at scale: archives, duplicates, filters, encodings."""
