"""Operators of a training-data pipeline: quality, duplicates, secrets, mixing, media, toxicity, language models, tokens and archives."""
