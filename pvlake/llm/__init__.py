"""Operators for large text corpora: cleaning, deduplication, decontamination, formatting and packing.

Nothing outside this folder imports it. Conventions shared by all operators: columns whose
names begin with ``_llm_`` are reserved; input columns that carry the name of an output column
are replaced; every other input column is kept as it is.
"""
