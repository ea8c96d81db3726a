"""Corpus preparation for language-model training. Nothing outside imports this."""
