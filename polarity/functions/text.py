"""Text column expressions. All are built-in Spark expressions (JVM side, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from polarity.config import CYRILLIC_WORD, STAMP_FORMAT


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def words(col, pattern: str = CYRILLIC_WORD) -> Column:
    """Maximal runs of the word pattern, in text order; no lower-casing. Null text -> []."""
    return F.coalesce(F.regexp_extract_all(_c(col), F.lit(f"({pattern})"), 1),
                      F.array().cast("array<string>"))


def clean(col, pattern: str = CYRILLIC_WORD) -> Column:
    """Cleaned text: the words joined by one space (no trailing space)."""
    return F.array_join(words(col, pattern), " ")


def strip_markup(col, pattern: str = CYRILLIC_WORD) -> Column:
    """Strip lemmatiser markup such as ``form{lemma}`` by keeping only the word runs."""
    return clean(col, pattern)


def text_state(col, pattern: str = CYRILLIC_WORD) -> Column:
    """'empty' for a null or empty text, 'foreign' when no word matches, else 'ok'."""
    c = _c(col)
    return (F.when(c.isNull() | (c == ""), F.lit("empty"))
            .when(F.size(words(c, pattern)) == 0, F.lit("foreign"))
            .otherwise(F.lit("ok")))


def ngrams(words_col, n: int) -> Column:
    """Word n-grams of sizes 1..n: at each position the 1-, 2-, ..., n-word phrase, cut at the end.

    A text of L words yields sum_j max(0, L - j + 1) phrases.  Pure array expressions, so the
    whole bag of a text is built inside one task without a shuffle.
    """
    w = _c(words_col)

    def phrase(j):  # each word with the j - 1 words behind it, picked by place: no slice is copied
        return lambda x, i: F.concat(x, *[y for k in range(1, j) for y in (F.lit(" "), F.get(w, i + k))])

    # slice: a text shorter than j words has none of them
    parts = [w if j == 1 else F.transform(F.slice(w, 1, F.greatest(F.size(w) - (j - 1), F.lit(0))), phrase(j))
             for j in range(1, n + 1)]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def split_list(col, sep: str = ",") -> Column:
    """Split on a literal separator and drop empty items."""
    pattern = "".join("\\" + ch if not ch.isalnum() else ch for ch in sep)
    return F.filter(F.split(_c(col), pattern), lambda x: x != "")


_NUMBER_PREFIX = r"^\s*([+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?))"


def prefix_number(col) -> Column:
    """C ``atof``: the longest numeric prefix after leading blanks, else 0.0."""
    return F.coalesce(F.regexp_extract(_c(col), _NUMBER_PREFIX, 1).try_cast("double"), F.lit(0.0))


def prefix_int(col) -> Column:
    """C ``atoi``: the longest integer prefix after leading blanks, else 0."""
    return F.coalesce(F.regexp_extract(_c(col), r"^\s*([+-]?\d+)", 1).try_cast("bigint"),
                      F.lit(0).cast("bigint"))


def strict_number(col, type_: str = "double") -> Column:
    """Whole-token parse; null when the token is not a number of the type."""
    c = _c(col)
    if type_ in ("int", "bigint"):
        return F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast(type_))
    return F.when(c.rlike(r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)$"),
                  c.try_cast("double"))


def stamp(col) -> Column:
    """Run stamp text, day.month.year-hours:minutes:seconds."""
    return F.date_format(_c(col), STAMP_FORMAT)


def fill_empty(cells_col) -> Column:
    """Empty cells become one blank, as the reference's ';;' -> '; ;' fill."""
    return F.transform(_c(cells_col), lambda x: F.when(x == "", F.lit(" ")).otherwise(x))


def parse_message(col) -> Column:
    """``id<TAB>text`` -> struct(id, text); the first tab splits, the text may hold more tabs.  A
    message without a tab is an id with an empty text."""
    parts = F.split(_c(col), "\t", 2)
    return F.struct(F.get(parts, 0).alias("id"), F.coalesce(F.get(parts, 1), F.lit("")).alias("text"))
