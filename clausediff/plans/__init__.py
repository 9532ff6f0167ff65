"""Registered queries and their plans."""
