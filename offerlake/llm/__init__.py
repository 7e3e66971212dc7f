"""Training-data operators over the tables documents, pages, labels and benchmark.

Nothing else in the library imports this subpackage.
"""
