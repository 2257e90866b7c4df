"""Training-data operators: filtering, deduplication, tokenising, packing and search.

Nothing outside this subpackage imports it; ``queries`` in :mod:`nodeloom.llm.queries` lists what the entry module offers.
"""
