"""Operators for training-data pipelines. Importing ``featherloom.llm.queries`` gives their registered queries."""
