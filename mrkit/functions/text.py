from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_words(text: str | Column) -> Column:
    """The words of a text, cut at every single space.

    Only U+0020 separates, so tabs and newlines stay inside words. Empty words in front of or between words are kept,
    those at the end are dropped: ``'a  b  '`` gives ``['a', '', 'b']``, ``'   '`` gives ``[]`` and ``''`` gives
    ``['']``. Words are exact strings; nothing is folded or stripped.
    """
    text = F.col(text) if isinstance(text, str) else text
    trimmed = F.rtrim(text)
    blank = (trimmed == "") & (text != "")
    return F.when(blank, F.array().cast("array<string>")).otherwise(F.split(trimmed, " ", -1))
