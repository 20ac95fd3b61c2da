"""Training-data operators: scrubbing, counting, matching, sharding, packing and archives.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
