"""Subpackage streaming of setweave."""
