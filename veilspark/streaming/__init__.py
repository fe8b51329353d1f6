"""Rules over streams of pages."""
