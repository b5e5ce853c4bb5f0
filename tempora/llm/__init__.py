"""Operators for training-data pipelines; queries are registered in ``tempora.llm.queries``."""
