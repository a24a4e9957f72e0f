"""Operators for preparing language-model training data.

Nothing outside this folder (and ``corpus_pipeline.py`` at the repository top)
imports from it, so it can be removed as a whole.
"""
