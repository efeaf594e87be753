"""Training-data operators: mixing, packing, line dedup, license scan, chat formatting,
quality rules, PII, exact top-k search, n-gram Jaccard join and quality classifier.

Nothing else in the library imports this package; its queries are in ``queries.py``.
"""
