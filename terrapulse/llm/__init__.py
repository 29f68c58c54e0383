"""Operators for text corpora: tokens, toxicity, near copies, archives, filters, languages and quality."""
