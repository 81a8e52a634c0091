"""Training-data operators over a corpus of documents.

Nothing outside this subpackage imports it.
"""
