"""Training-data operators: quality, toxicity, language, packing, dedup, PII, licences.

Nothing outside this package imports it; ``queries.py`` registers its queries.
"""
