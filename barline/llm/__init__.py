"""Training-data operators: deduplication, decontamination, PII, scoring, mixing.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrames to a DataFrame; the thin ``opN_*`` queries live in ``queries.py``.
"""
