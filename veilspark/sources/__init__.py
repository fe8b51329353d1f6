"""Inputs: rule books, pages, plans."""
