"""Mixing sources to target weights.

Every document gets a hash-random key; within its source the documents are
range-sorted by it, token counts become distributed prefix sums, and the
source is cut at its exact budget, over as many epochs as the budget needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import write_table

#: Fixed values of the contract.
WEIGHT_CYCLE = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def word_count(text) -> F.Column:
    """Number of runs of characters other than space and 0x09..0x0D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS,
                   cycle: tuple = WEIGHT_CYCLE) -> DataFrame:
    """(source, source_size, n_docs) -> the same rows with weight and target.

    Sources in code-point order, null last, take the weights of ``cycle`` in
    turn and share ``share`` of all words by weight. A target stops at
    ``max_epochs`` times its source's size; what is over goes to the others by
    weight until none is above. That level is found in closed form: with the
    sources sorted by size per weight, the first ones that stop are a prefix,
    so one running sum over the (one row a source) table gives the level.
    An empty source, or an empty corpus, gets 0."""
    one = W.orderBy(F.col("source").isNull(), F.col("source"))
    weights = F.array(*[F.lit(int(w)) for w in cycle])
    s = sizes.withColumn("weight", F.element_at(weights, ((F.row_number().over(one) - 1) % len(cycle) + 1).cast("int")))
    order = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    cap = F.col("source_size") * max_epochs
    s = (s.withColumn("rest_words", F.lit(share) * F.sum("source_size").over(every)
                      - F.coalesce(F.sum(cap).over(before), F.lit(0)))
         .withColumn("rest_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
         .withColumn("rate", F.col("rest_words") / F.col("rest_weight"))
         .withColumn("stops", cap <= F.col("rate") * F.col("weight"))
         .withColumn("level", F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("weight"),
                                                                     F.col("rate")))).over(every)["rate"]))
    return s.select("source", "source_size", "n_docs", "weight",
                    F.when(F.col("stops"), cap.cast("double")).otherwise(F.col("level") * F.col("weight"))
                    .alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
             carry: tuple = (), **knobs) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken.

    ``taken`` counts the words that the mix takes from the document, repeats
    included: whole epochs take every document once, and the last, partial
    epoch takes documents in the order of their key until the budget is used;
    the document on the border gives only the words still wanted, so a
    source's taken words add up to floor(target). No document exceeds the
    epoch limit. ``carry`` names further columns to keep.

    Keys are md5 of id and epoch, so reruns and other partitionings agree;
    rows with one id are ordered by size, and identical rows are exchangeable.
    A null id is keyed as the word 'null'; null and empty texts have size 0 and
    take 0. A null source is a source of its own, the last.

    A source of n documents is cut into about sqrt(n) ranges of the key, so a
    hot source fills many tasks; the window over a source runs on those ranges'
    sums only (sqrt(n) rows). Ranges before the one that the budget ends in are
    taken whole and those after it not at all, so only that one range of a
    source (about sqrt(n) rows) is shuffled with its columns and ordered."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       word_count(F.col(text_col)).alias("size"), *carry)
    rows = write_table(rows, "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = write_table(source_targets(sizes, **knobs), "mix-targets")
    keyed = (targets.withColumnRenamed("source", "t_source")
             .withColumn("budget", F.floor("target"))
             .withColumn("epochs", F.when(F.col("source_size") > 0,
                                          F.floor(F.expr("budget div source_size"))).otherwise(0).cast("long"))
             .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
             .withColumn("ranges", F.ceil(F.sqrt("n_docs")).cast("long")))

    def in_cells(known: DataFrame) -> DataFrame:
        return (rows.join(known, F.col("source").eqNullSafe(F.col("t_source")))
                .withColumn("key", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                                                     F.col("epochs").cast("string")).cast("binary")))
                .withColumn("cell", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
                                            * F.col("ranges") / F.lit(float(1 << 32))).cast("long")))
    cells = in_cells(keyed).groupBy("t_source", "rest", "cell").agg(F.sum("size").alias("cell_size"))
    ahead = W.partitionBy("t_source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("offset", F.coalesce(F.sum("cell_size").over(ahead), F.lit(0)))
    ends = (cells.where((F.col("offset") < F.col("rest")) & (F.col("rest") <= F.col("offset") + F.col("cell_size")))
            .select(F.col("t_source").alias("c_source"), F.col("cell").alias("end_cell"), "offset"))
    known = write_table(keyed.join(ends, F.col("t_source").eqNullSafe(F.col("c_source")), "left").drop("c_source"), "mix-ends")
    x = in_cells(known)
    inside = W.partitionBy("t_source").orderBy("key", "size").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    border = (x.where("cell = end_cell")
              .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start))))
    others = (x.where("end_cell IS NULL OR cell <> end_cell")
              .withColumn("part", F.when(F.col("cell") < F.col("end_cell"), F.col("size")).otherwise(0)))
    return others.unionByName(border).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"),
        F.col("epochs").alias("whole_epochs"), F.col("part").cast("long").alias("part"), *carry)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                    text_col: str = "text", **knobs) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row per whole epoch, and
    for the partial epoch a row with the words that it takes (the text up to
    the end of the last of them). Documents of no words are kept once: they
    cost nothing. Extra columns are carried along under any name."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_")
    packed = docs.select(F.col(f"`{id_col}`").alias("id_"), F.col(f"`{source_col}`").alias("source_"),
                         F.col(f"`{text_col}`").alias("text_"), row)
    plan = mix_plan(packed, "id_", "source_", "text_", carry=("row_",), **knobs)
    text = F.col("row_")[text_col]
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each a word and the white space before it
    cut = F.when(F.col("part") == F.col("size"), text).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.col("part").cast("int")), ""))
    times = (F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("whole_epochs"))).cast("int")
    whole = F.array_repeat(F.struct(F.lit(False).alias("is_part")), times)
    more = F.when(F.col("part") > 0, F.array(F.struct(F.lit(True).alias("is_part")))).otherwise(
        F.array().cast("array<struct<is_part:boolean>>"))
    out = plan.withColumn("turn_", F.explode(F.concat(whole, more)))
    fields = [F.when(F.col("turn_.is_part"), cut).otherwise(text).alias(c) if c == text_col
              else F.col("row_")[c].alias(c) for c in docs.columns]
    return out.select(*fields)
