"""Registered queries over the reference tables, each with its SQL twin."""
