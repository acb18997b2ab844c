"""Training-data operators: language ID, LM scoring, search, deduplication, packing and the rest.

Nothing outside this subpackage imports it.  ``registry`` names its queries.
"""
