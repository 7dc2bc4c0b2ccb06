"""Quality rules from DataFrame functions only: base rules and cross-document lines.

Lines are normalised and hashed, distinct documents are counted per host and line, lines
above the limits are taken out of the texts, and documents that lose most of their words
are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import SPACE_CHARS, SPACES, let, lower_ascii, words
from panelspark.session import materialize

SYMBOLS = "#*$%&|<>"
#: A line is boilerplate of a host if it is in at least so many of its documents ...
MIN_DOCS = 5
#: ... and in over this share of them, in percent, or in over so many at all.
MAX_PERCENT, MAX_DOCS = 1, 1000
#: A document is depleted if fewer than this share of its words is left, in percent.
MIN_LEFT_PERCENT = 75


def _repeated_words(ws: Column) -> Column:
    """How many of the words lie in a 3-word window that occurs twice or more.

    Windows of a text are compared by their 64-bit hash.  Most texts repeat none, which a
    set of the hashes tells; those of the rest are sorted with their places.
    """
    starts = F.sequence(F.lit(0), F.size(ws) - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))

    def twice(s: Column) -> Column:
        kept = F.filter(
            s,
            lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)),
        )
        return F.sort_array(F.transform(kept, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.coalesce(F.least(F.lit(3), p - F.get(at, k - 1)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    def found(hs: Column) -> Column:
        placed = F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        repeated = let(F.sort_array(placed), lambda s: let(twice(s), covered))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(repeated)

    return F.when(F.size(ws) < 4, F.lit(0)).otherwise(let(hashes, found))


def base_columns(text: Column) -> dict[str, Column]:
    """The per-document counts of the base rules; null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    packed = F.translate(text, SPACE_CHARS, "")
    full = F.filter(F.split(text, "\n"), lambda line: F.translate(line, SPACE_CHARS, "") != "")
    both = let(words(text), lambda ws: F.struct(F.size(ws).cast("long").alias("n"), _repeated_words(ws).cast("long").alias("r")))
    return {
        "__words": both,
        "word_chars": F.length(packed).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    counted = docs.withColumns(base_columns(F.col(text)))
    counted = counted.withColumn("n_words", F.col("__words.n")).withColumn("n_repeat_words", F.col("__words.r")).drop("__words")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _tidy(line: Column) -> Column:
    return F.trim(F.regexp_replace(lower_ascii(line), SPACES, " "))


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, host, h, n): the lines with a word of each row, hashed, with their words."""

    def hashed(line: Column) -> Column:
        return let(_tidy(line), lambda t: F.struct(F.xxhash64(t).alias("h"), (F.length(t) - F.length(F.translate(t, " ", "")) + 1).alias("n"), (t != "").alias("full")))

    lines = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), hashed)
    rows = docs.select("doc_id", "host", F.explode(F.filter(lines, lambda x: x["full"])).alias("l"))
    return rows.select("doc_id", "host", F.col("l.h").alias("h"), F.col("l.n").cast("long").alias("n"))


def frequent_lines(
    lines: DataFrame, min_docs: int = MIN_DOCS, max_percent: int = MAX_PERCENT, max_docs: int = MAX_DOCS
) -> DataFrame:
    """(host, h, first_doc) of the lines of ``document_lines`` that are boilerplate of their host.

    The limit is a share of the host's documents, at least ``min_docs`` and at most
    ``max_docs`` of them, so it neither vanishes in small hosts nor grows without end in
    large ones.  Documents without a line with a word don't count.  A line stays in the
    smallest doc_id of its host; rows with one doc_id are one document.  A null host is a
    host of its own.
    """
    held = lines.select("host", "h", "doc_id").distinct()
    counts = held.groupBy("host", "h").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    sizes = lines.select("host", "doc_id").distinct().groupBy("host").agg(F.count("*").alias("n_host"))
    sizes = sizes.withColumnRenamed("host", "__host")
    above = counts.filter(F.col("n_docs") >= min_docs).join(sizes, F.col("host").eqNullSafe(F.col("__host")))
    many = (100 * F.col("n_docs") > max_percent * F.col("n_host")) | (F.col("n_docs") > max_docs)
    return above.filter(many).select("host", "h", "first_doc")


def line_losses(docs: DataFrame, min_left_percent: int = MIN_LEFT_PERCENT, **limits: int) -> DataFrame:
    """(doc_id, depleted, gone) of (doc_id, host, text) rows with a line with a word.

    ``gone`` has (host, h) of the document's lines that are frequent in its host and stay in
    another document; ``depleted`` tells that too few of its words are left without them.
    Rows without a doc_id are left out.  ``limits`` are those of ``frequent_lines``.
    """
    lines = materialize(document_lines(docs.filter("doc_id IS NOT NULL")), "lines")
    above = frequent_lines(lines, **limits).select(
        F.col("host").alias("__host"), F.col("h").alias("__h"), "first_doc"
    )
    lost = (F.col("__h").isNotNull()) & (F.col("first_doc") != F.col("doc_id"))
    marked = lines.join(above, F.col("host").eqNullSafe(F.col("__host")) & (F.col("h") == F.col("__h")), "left")
    sums = marked.groupBy("doc_id").agg(
        F.sum("n").alias("all"),
        F.sum(F.when(~lost, F.col("n")).otherwise(0)).alias("left"),
        F.collect_set(F.when(lost, F.struct("host", "h"))).alias("gone"),
    )
    return sums.select("doc_id", (100 * F.col("left") < min_left_percent * F.col("all")).alias("depleted"), "gone")


def surviving_text(text: Column, host: Column, gone: Column) -> Column:
    """The text's lines, as they are and in order, that ``gone`` of ``line_losses`` doesn't name."""
    own = F.transform(F.filter(gone, lambda g: g["host"].eqNullSafe(host)), lambda g: g["h"])

    def stays(hashes: Column) -> Column:
        # the hash of a blank line is none of a line with a word
        lines = F.filter(F.split(text, "\n"), lambda line: ~F.array_contains(hashes, F.xxhash64(_tidy(line))))
        return F.array_join(lines, "\n")

    return let(own, stays)


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, base columns, kept) for every row of ``docs``.

    Null text has no words and fails the base rules.  No rows give none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).alias("host"), "text")
    based = base_rules(rows).drop("text", "host")
    bad = line_losses(rows).filter("depleted").select(F.col("doc_id").alias("__bad"))
    joined = based.join(bad, F.col("doc_id") == F.col("__bad"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("__bad").isNull()).drop("__bad")


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass the base rules and are not depleted, with all columns.

    Their text is without the frequent lines that stay in another document of the host, and
    n_chars, where there is one, counts what is left.  The base rules see the whole text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).alias("host"), "text")
    losses = line_losses(rows).filter("depleted OR size(gone) > 0").select(
        F.col("doc_id").alias("__lost_doc"), F.col("depleted").alias("__lost_all"), F.col("gone").alias("__lost_lines")
    )

    def passes(ws: Column) -> Column:
        return (F.size(ws) >= 50) & (100 * _repeated_words(ws) <= 50 * F.size(ws))

    good = docs.filter(let(words(F.col("text")), passes))
    kept = good.join(losses, good["doc_id"] == losses["__lost_doc"], "left").filter("__lost_all IS NULL OR NOT __lost_all")
    lost = F.col("__lost_lines").isNotNull()
    kept = kept.withColumn("text", F.when(lost, surviving_text(F.col("text"), F.col(host), F.col("__lost_lines"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        count = F.length("text").cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn("n_chars", F.when(lost, count).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)
