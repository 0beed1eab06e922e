"""Whole pipelines, from scans to results."""
