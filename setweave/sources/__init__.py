"""Subpackage sources of setweave."""
