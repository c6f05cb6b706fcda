"""Training-data operators: near-duplicates, quality, clusters, neighbours,
subjects, packing, mixing and template residue.

Nothing outside this subpackage imports it.
"""
