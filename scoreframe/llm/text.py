"""Text helpers the corpus operators share: what counts as a word, and row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole(text: str | Column = "text") -> Column:
    """The text, a missing one as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words_of(text: Column) -> Column:
    """Runs of characters other than space and the controls 9 to 13."""
    return F.array_remove(F.split(text, BLANKS), "")


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def row_key(id_column: str = "doc_id", text: str = "text") -> Column:
    """A key for a row that holds across passes; equal rows share it, and their results."""
    return F.concat_ws(":", F.coalesce(F.col(id_column).cast("string"), F.lit("-")),
                       F.hex(F.xxhash64(whole(text))), F.hex(F.xxhash64(F.lit(7), whole(text))))

