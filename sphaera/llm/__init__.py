"""Operators of a training-data pipeline. Nothing outside this folder,
``corpus_pipeline.py`` and ``tests/llm`` imports them."""
