"""Training-data operators over large text corpora.

Self-contained: nothing else in the library imports this package.
"""
