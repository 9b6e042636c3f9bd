"""Operators for preparing training data: tokens, quality, duplicates, mixing, toxicity and language-model scores."""
