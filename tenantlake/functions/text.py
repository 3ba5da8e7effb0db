"""Text and time helpers, all plain Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of any script, and the four separators a Unicode-aware strip removes too.
_BLANK = r"[\s\x1c-\x1f]+"
_BLANKS = "".join(chr(c) for c in (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove leading and trailing white space of any script; NULL becomes ''."""
    return F.btrim(F.coalesce(col(c), F.lit("")), F.lit(_BLANKS))


def blank_to_null(c: Column | str) -> Column:
    """NULL for ''. Not `nullif`: its shared subexpression adds a projection of its own,
    and a limit over a sort is only a top-k with a single projection between them."""
    return F.when(col(c) != "", col(c))


def words(c: Column | str) -> Column:
    """White-space separated tokens of a text; NULL gives an empty array."""
    parts = F.split(F.coalesce(col(c), F.lit("")), rf"(?U){_BLANK}")
    return F.filter(parts, lambda w: w != "")


def iso_time(c: Column | str) -> Column:
    """yyyy-MM-ddTHH:mm:ss, six fraction digits only when there are any; NULL stays."""
    text = F.translate(col(c).cast("string"), " ", "T")
    return F.when(F.length(text) > 19, F.rpad(text, 26, "0")).otherwise(text)


def day(c: Column | str) -> Column:
    """yyyy-MM-dd, '' for NULL."""
    return F.coalesce(F.substring(col(c).cast("string"), 1, 10), F.lit(""))


def parse_time(c: Column | str) -> Column:
    """'yyyy-MM-dd HH:mm:ss' with or without a fraction; anything else is NULL."""
    shape = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?\z"
    return F.when(col(c).rlike(shape), col(c).try_cast("timestamp_ntz"))


def plus(c: Column | str, **parts: int) -> Column:
    """Add days / hours / mins to a time column."""
    return col(c) + F.make_dt_interval(
        *(F.lit(parts.get(unit, 0)) for unit in ("days", "hours", "mins")))


def token_key(c: Column | str) -> Column:
    """Sessions are stored under the hash of their token, never the token itself."""
    return F.sha2(col(c), 256)


def labelled(c: Column | str, labels: dict[str, str]) -> Column:
    """Look up a label in a fixed map; codes without a label are shown as they are."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(c)), col(c))


def detail_value(detail: Column | str, key: str) -> Column:
    """Value of the last `key=value` token of a log detail, NULL if there is none."""
    mark = f"{key}="
    hits = F.filter(words(detail), lambda w: w.startswith(mark))
    last = F.try_element_at(hits, F.lit(-1))
    return F.substring(last, F.lit(len(mark) + 1), F.length(last))


def detail_tokens(detail: Column | str) -> Column:
    """Every token of a log detail as {key, value}; bare tokens have a NULL key."""
    return F.transform(
        words(detail),
        lambda w: F.when(
            w.contains("="),
            F.struct(F.substring_index(w, "=", 1).alias("key"),
                     F.regexp_replace(w, r"(?s)^[^=]*=", "").alias("value")),
        ).otherwise(F.struct(F.lit(None).cast("string").alias("key"), w.alias("value"))),
    )
