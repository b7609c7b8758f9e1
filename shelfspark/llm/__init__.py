"""Operators for preparing training text: ten methods, each over whole tables."""
