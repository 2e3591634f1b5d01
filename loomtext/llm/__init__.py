"""Training-data operators: packing, mixing, deduplication, classifiers, extraction, language-model scores.

Nothing else in the library imports this subpackage.
"""
