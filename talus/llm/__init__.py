"""Training-data operators: filtering, deduplication, decontamination, packing and archives.

Nothing outside this subpackage imports it.
"""
