"""Training-data operators: quality, deduplication, tokenisation, scoring, privacy and licences.

Nothing else in the library imports this subpackage.
"""
