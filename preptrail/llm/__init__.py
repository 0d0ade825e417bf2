"""Operators for preparing training text: fixity, quality, duplicates, extraction, tokens, shards."""
