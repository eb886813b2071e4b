"""Training-data operators: dedup, packing, mixing, language ID, PII and quality rules.

Nothing outside this subpackage imports it.  Each module holds one operator with
a general interface plus the thin ``opN_*`` query that applies it to a table
directory; :mod:`civicpulse.llm.registry` lists the queries and their SQL.
"""
