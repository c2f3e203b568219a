"""Operators for training-data pipelines over document and page tables; nothing else in the library imports them."""
