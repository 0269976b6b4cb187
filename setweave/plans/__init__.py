"""Subpackage plans of setweave."""
