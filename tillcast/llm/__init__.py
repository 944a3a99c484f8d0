"""Training-data operators: decontamination, near-duplicates, filters, extraction, packing.

Nothing else in the library imports this subpackage.  ``queries`` registers one
query per operator; ``corpus_pipeline.py`` at the repository top chains five of
them.
"""
