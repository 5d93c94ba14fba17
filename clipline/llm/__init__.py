"""Operators for training-data pipelines over the tables ``documents``, ``labels`` and ``benchmark``."""
