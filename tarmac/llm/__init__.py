"""Operators of a training-data pipeline (documents, pages, conversations).

Nothing outside this subpackage, ``tests/llm`` and ``corpus_pipeline.py``
imports it.
"""
