"""Line deduplication: a line that several documents hold stays in one of them.

Normalised lines are exploded and hashed; distinct documents are counted per
hash; the lines over the threshold are dropped everywhere but in the document
of the smallest id, and the rest is put together again by position. Only
hashes, ids and positions are written and shuffled for the counting; texts are
split twice and move once, to meet the positions that they lose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table

#: Fixed values of the contract: the least code points of a key, the least documents that hold it.
MIN_LENGTH = 10
MIN_DOCS = 2
#: Keys that hold more than this share of all repeated lines are looked up from
#: a broadcast table; there can be no more than its inverse of them.
HOT_SHARE = 1 / 4096

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line) -> F.Column:
    """The line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased.

    ``lower`` takes ASCII by bytes; it would change other letters too, so lines
    that hold any go through the slower ``translate``."""
    bare = F.trim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def split_lines(text) -> F.Column:
    """The lines of a text, split at \\n; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame, min_length: int) -> DataFrame:
    """A row per line that is long enough: h1, h2 (128 bits of its key's hash),
    id_, text_hash_, pos_."""
    own = docs.where("id_ IS NOT NULL AND text_ IS NOT NULL").select("id_", "text_hash_", F.posexplode(split_lines(F.col("text_"))).alias("pos_", "line_"))
    keyed = own.select("id_", "text_hash_", "pos_", line_key(F.col("line_")).alias("key_")).where(F.char_length("key_") >= min_length)
    return keyed.select(F.xxhash64("key_").alias("h1"), F.xxhash64(F.lit(1), "key_").alias("h2"), "id_", "text_hash_", "pos_")


def repeated_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """Keys that ``min_docs`` distinct documents hold: h1, h2, first_ (the
    smallest id), n_ (lines). A key is in two documents where its smallest and
    its largest id differ, so one grouping with partial aggregates finds those;
    more documents are counted over their (key, document) pairs alone."""
    ends = lines.groupBy("h1", "h2").agg(F.min("id_").alias("first_"), F.max("id_").alias("last_"), F.count("*").alias("n_"))
    if min_docs <= 1:
        return ends.drop("last_")
    two = ends.where("first_ < last_").drop("last_")
    if min_docs == 2:
        return two
    two = write_table(two, "line-keys")
    counts = lines.join(two, ["h1", "h2"], "left_semi").select("h1", "h2", "id_").distinct().groupBy("h1", "h2").agg(F.count("*").alias("docs_"))
    return two.join(counts.where(F.col("docs_") >= min_docs), ["h1", "h2"]).drop("docs_")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per input row: doc_id, text (the lines that stay, joined by \\n),
    n_lines (before dropping), n_dropped.

    A key of ``min_length`` code points or more that ``min_docs`` documents
    hold loses all its lines, except those of the smallest id that holds it
    (all of its lines there stay). Other lines stay as they are, also blank
    ones. Documents are told apart by id: rows that share one are one document.
    A row without an id loses no line and counts for no key. A null text is one
    empty line and gives an empty text; so does a text that loses all its
    lines. Repeated rows give equal rows, an empty table an empty one; texts
    may be of any length, as a document's lines are dealt out by key and only
    the positions that it loses come together. Other columns are not read, so
    their names can't clash.

    A hot key is no hot task: keys are counted with partial aggregates, those
    with a large share of all repeated lines (at most 4,096) are looked up
    from a broadcast table, and only the others are joined by key."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id_"), text.alias("text_"), F.xxhash64(text).alias("text_hash_"))
    lines = write_table(hashed_lines(rows, min_length), "lines")  # read three times
    keys = write_table(repeated_keys(lines, min_docs), "line-keys")
    least = F.lit((keys.agg(F.sum("n_")).first()[0] or 0) * HOT_SHARE)
    hot, rest = keys.where(F.col("n_") > least), keys.where(F.col("n_") <= least)
    looked = lines.join(F.broadcast(hot.select("h1", "h2", F.col("first_").alias("hot_"))), ["h1", "h2"], "left")
    place = ["id_", "text_hash_", "pos_"]
    lost = (looked.where("id_ > hot_").select(place)
            .unionByName(looked.where("hot_ IS NULL").drop("hot_").join(rest, ["h1", "h2"]).where("id_ > first_").select(place)))
    lost = lost.groupBy("id_", "text_hash_").agg(F.collect_set("pos_").alias("lost_"))
    whole = rows.select("id_", "text_hash_", split_lines(F.col("text_")).alias("lines_")).join(lost, ["id_", "text_hash_"], "left")
    # A set difference finds the positions that stay in time linear in the lines.
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines_") - 1), F.col("lost_"))
    kept = F.when(F.col("lost_").isNull(), F.col("lines_")).otherwise(F.transform(stay, lambda i: F.col("lines_")[i]))
    return whole.select(F.col("id_").alias("doc_id"), F.array_join(kept, "\n").alias("text"), F.size("lines_").cast("long").alias("n_lines"),
                        F.when(F.col("lost_").isNull(), 0).otherwise(F.size("lost_")).cast("long").alias("n_dropped"))
