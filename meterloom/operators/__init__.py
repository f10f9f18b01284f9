"""Operators over panels: every function takes ``keys``, the columns that name one series."""
