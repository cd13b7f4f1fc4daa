"""Catalogue streaming."""
