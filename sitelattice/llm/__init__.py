"""Training-data operators: filtering, deduplication, decontamination, mixing, sharding and scoring.

Nothing outside this subpackage imports it.
"""
