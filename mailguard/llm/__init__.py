"""Training-data operators (URL filters, packing, deduplication, PII, search, classifiers, BPE).

Nothing else in the library imports this subpackage.  ``entry.py`` holds the
registered queries and their SQL.
"""
