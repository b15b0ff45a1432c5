"""Training-data operators: near-duplicates, quality, language, personal data, secrets, tokens and scores.

Nothing outside this subpackage imports it.
"""
