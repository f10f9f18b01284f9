"""The daily roll-up on an unbounded input."""
