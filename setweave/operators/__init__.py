"""Subpackage operators of setweave."""
