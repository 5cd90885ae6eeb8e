"""Training-data operators: deduplication, scanning, classification, packing, scoring.

Nothing else in the package imports this subpackage.
"""
