"""Matchers, span algebra, tables, location on recognised pages."""
