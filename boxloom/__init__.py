"""Spark jobs for tables of boxes (object detection data) and, in ``llm``, for training text."""
