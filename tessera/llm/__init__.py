"""Training-data operators: dedup, classification, extraction, packing and filtering of documents.

Nothing else in the library imports this subpackage.
"""
