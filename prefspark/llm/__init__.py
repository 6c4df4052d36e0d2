"""Training-data operators: language ID, near duplicates, repeated substrings, decontamination,
packing, token files, toxicity, HTML extraction, fingerprints and n-gram scoring.

Nothing else in the library imports this subpackage; the queries are in ``queries.py``.
"""
