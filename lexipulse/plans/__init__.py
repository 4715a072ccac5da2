"""Whole analyses and the views of their results."""
