"""Training-data operators: archives, fingerprints, sharding, filtering, mixing, tokens.

Nothing outside this subpackage imports it, and it imports nothing from the
rest of the library, so it can be added or removed on its own.
"""
