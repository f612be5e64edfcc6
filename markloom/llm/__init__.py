"""Operators that a training-data pipeline needs: sharding, mixing, near-duplicates, PII, language,
quality, fingerprints, token records, BPE and HTML main text. Nothing outside this package imports it."""
