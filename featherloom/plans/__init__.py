"""Composition of operators: transform chains and declared multi-stage flows."""
