"""Relational operators: matching, measures, emerging terms."""
