"""Scans: transaction facts, source dimension, thresholds, uploads."""
