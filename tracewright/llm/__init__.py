"""Operators for training text: pairs, conversations, provenance, splitting, packing, leaks and cut texts."""
