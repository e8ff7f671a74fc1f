"""Pieces that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from shocklens.session import saved

__all__ = ["BLANKS", "ascii_lower", "saved"]

# The six ASCII white-space characters, space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
