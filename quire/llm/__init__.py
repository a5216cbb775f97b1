"""Operators for training-data pipelines (dedup, mixing, packing, filtering, scoring).

Nothing else in the library imports this subpackage; `quire.llm.queries` lists its
registered queries.
"""
