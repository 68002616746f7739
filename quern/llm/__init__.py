"""Training-data operators: counting, decontamination, deduplication, filtering, indexing and packing.

Nothing else in the package imports this folder.
"""
