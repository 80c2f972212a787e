"""Training-data operators: near-duplicate search, packing, scoring, redaction and friends.

Nothing outside this folder imports it.
"""
