"""Catalogue sources."""
