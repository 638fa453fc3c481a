"""Corpus-preparation operators for training data at scale.

Nothing outside this subpackage imports it.
"""
