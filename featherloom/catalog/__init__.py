"""Registered queries by family. Importing this package fills the registry."""

from featherloom.catalog import (  # noqa: F401
    columns,
    encoding,
    evaluation,
    flows,
    records,
    splits,
    text,
)
from featherloom.catalog.registry import CHECKS, QUERIES, TABLES  # noqa: F401
