"""Operators of a training-data pipeline over whole document and page tables. Nothing else in the library imports them."""
