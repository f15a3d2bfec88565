"""Training-data operators: tokenising, packing, filtering, deduplication, scoring.

Nothing outside this package imports it. Every operator is a function of
DataFrames; ``queries.py`` registers one production query for each.
"""
