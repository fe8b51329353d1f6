"""Editable plans, redaction with read-back, reports."""
