"""Line dedup: lines that many documents share stay only in the last of them.

A text is split at newlines; the key of a line is the line without white space
`[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased.  A key of at least ``least``
code points that at least ``spread`` documents hold loses all its lines except
those of the document with the largest id that holds it; the rest of a text is
put together again in its order.

Plan: lines are exploded with their place and hashed (two 64-bit hashes, so no
text is shuffled by line).  The documents of a hash are counted distinct with
partial sums by (hash, document) first, so a line of a third of all documents
arrives as partial counts.  The hashes over the threshold meet the lines again
in a plain join, dealt by hash, document group (16 of them) so that one common
line is sixteen keys, which AQE splits further; places to drop go back to
their text.  All of it is DataFrame functions.

Cases: a null or empty text is one empty line; a text is one document per
distinct id, so rows that repeat an id count once and each loses its lines;
all rows with a null id count as one document, before every other id, and lose
their lines as others do; ties cannot occur (ids differ); an empty table gives
an empty result.  Other columns ride in a struct, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privtab.llm import common as C

LEAST, SPREAD = 40, 5
#: Parts that the documents of one line are dealt into for the join.
PARTS = 16

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """Stripped, A-Z lower-cased.  ``lower`` is the faster way for plain ASCII;
    it would also change letters beyond A-Z, so others are translated."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def keyed_lines(base: DataFrame, least: int) -> DataFrame:
    """(doc_id, sig, place, h1, h2) of every line whose key is long enough."""
    lines = base.select("doc_id", "sig", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    keys = lines.filter(F.octet_length("line") >= least).select("doc_id", "sig", "place", line_key(F.col("line")).alias("key"))
    return keys.filter(F.length("key") >= least).select(
        "doc_id", "sig", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def common_lines(lines: DataFrame, spread: int) -> DataFrame:
    """(h1, h2, last, n_docs) of the keys that at least ``spread`` documents hold."""
    each = lines.select("h1", "h2", "doc_id").distinct()
    return (each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last"))
            .filter(F.col("n_docs") >= spread))


def without(lines: Column, places: Column) -> Column:
    """The lines but those at sorted ``places``: slices between them, in order."""
    ends = F.concat(F.array(F.lit(-1)), places, F.array(F.size(lines)))
    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(ends) - 1), lambda i: F.slice(
        lines, F.element_at(ends, i) + 2, F.element_at(ends, i + 1) - F.element_at(ends, i) - 1)))


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
                      spread: int = SPREAD, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, carry (a struct of the named columns), n_lines
    (before dropping), dropped (sorted places of the lines that go), n_dropped
    and kept_text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), C.carried(carry))
    base = base.withColumn("sig", F.xxhash64("text"))
    lines = keyed_lines(base.select("doc_id", "sig", "text"), least)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")
    common = common_lines(lines, spread).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    # a text's places: at most its own lines; rows that repeat id and text have the same
    dropped = (lines.withColumn("part", part).join(common, ["h1", "h2", "part"])
               .filter(~F.col("doc_id").eqNullSafe(F.col("last")))
               .groupBy(F.col("doc_id").alias("k"), F.col("sig").alias("s"))
               .agg(F.array_sort(F.collect_set("place")).alias("places")))
    out = base.join(dropped, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("sig") == F.col("s")), "left")
    split = F.split("text", "\n")
    return out.select(
        "doc_id", "carry", F.size(split).cast("long").alias("n_lines"),
        F.coalesce("places", F.array().cast("array<int>")).alias("dropped"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("places").isNull(), F.col("text")).otherwise(
            F.array_join(without(split, F.col("places")), "\n")).alias("kept_text"))
