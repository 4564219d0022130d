"""Training-data operators: sharding, cleaning, duplicate removal, tokens and archives.

Nothing else in the library imports this subpackage; its queries are in
:mod:`timeloom.llm.queries`.
"""
