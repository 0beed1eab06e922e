"""Append-only tables and exports."""
