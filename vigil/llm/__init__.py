"""Operators of a training-data pipeline: mixing, language ID, near-duplicate
search, tokenisation, licence scans, fingerprints, passage dedup, chat
formatting and binary token output.

Nothing else in the library imports this subpackage. ``plans`` registers one
query per operator; ``corpus_pipeline.py`` at the repository top chains five of
them.
"""
