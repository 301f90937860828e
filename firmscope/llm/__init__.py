"""Training-data operators: dedup, decontamination, scoring, packing, mixing.

Nothing outside this package imports it. Every operator takes DataFrames plus
column names and returns a DataFrame; the ``opN_*`` entries in ``queries`` bind
them to the documents, pages, conversations, labels and benchmark tables.
"""
