"""Subpackage functions of setweave."""
