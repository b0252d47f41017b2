"""Training-data operators: mixing, quality, near-duplicates, secrets, lines, chat, licences, packing, search, toxicity.

Nothing outside this subpackage imports it.
"""
