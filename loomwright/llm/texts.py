"""What several text operators share: white space, A-Z lower-casing, row keys, hash folds."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Six ASCII white-space characters; exactly those at which ``bytes.split()`` splits.
WORD = r"[^\x20\x09-\x0D]+"

#: Table for ``bytes.translate``: A-Z become a-z, every other byte of UTF-8 stays.
LOWER_AZ = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z only; ``lower`` would change other letters too."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def utf8(text: Column) -> Column:
    """The text's bytes, null as empty: Python workers then need no decoding."""
    return F.coalesce(text, F.lit("")).cast("binary")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)
