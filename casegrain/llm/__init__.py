"""Training-data operators: packing, tokens, deduplication, filters, archives.

Nothing outside this subpackage imports it.
"""
