"""Operators that prepare documents and web pages for language-model training."""
