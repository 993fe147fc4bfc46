"""Mixing sources to target weights, in DataFrame functions alone.

Tokens are summed for each source; weights share out a total, with no source above
``max_repeats`` times its size; a source's rate is target / size. A document is emitted
floor(rate) times, and once more if a hash of its id falls under the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.common import broadcast_if_small, hot_keys, join_split, materialize

#: Words of the contracts here: runs of anything but white space.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that only ``doc_id`` and ``seed`` decide: 48 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def _weighed(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size, w): sources by code point, null last, get ``weights`` in turn.

    Sources are ranked inside ranges of names, to which the rows before each range are added, so no task takes
    them all. The driver sees one row a range.
    """
    by = [F.col("source").isNull(), F.encode("source", "utf-8")]
    ranged = materialize(sizes.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "sources")
    before, at = {}, 0
    for r in sorted(ranged.groupBy("part").count().collect()):
        before[r["part"]], at = at, at + r["count"]
    starts = F.broadcast(ranged.sparkSession.createDataFrame([*before.items()] or [(0, 0)], "part int, before long"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*by)) - 1
    ranked = ranged.withColumn("rank", rank).join(starts, "part")
    return ranked.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") + F.col("before")) % len(weights) + 1).cast("int")).cast("long").alias("w"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """(source, source_size) to (source, source_size, target), by water-filling.

    Sources by code point, null last, weigh ``weights`` in turn. All get the same words for each unit of weight, but those
    that this would take above ``max_repeats`` times their size stop there, and what they leave raises the level of the
    others, until none is above. Each step is an aggregate over one row a source, two numbers to the driver.
    """
    weighed = materialize(_weighed(sizes, weights), "weighed")
    total, all_w = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    stopped, stopped_w = 0, 0
    most = max_repeats * F.col("source_size")
    while True:
        left, over = share * float(total) - float(max_repeats * stopped), float(all_w - stopped_w)
        if over <= 0:  # all are at their bounds
            return weighed.select("source", "source_size", most.cast("double").alias("target"))
        above = F.lit(left / over) * F.col("w") > most
        now = weighed.filter(above).agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
        if tuple(now) == (stopped, stopped_w):
            return weighed.select("source", "source_size", F.when(above, most.cast("double")).otherwise(F.lit(left / over) * F.col("w")).alias("target"))
        stopped, stopped_w = now


def _with_copies(docs: DataFrame, names: tuple[str, str, str], weights: tuple[int, ...], share: float, max_repeats: int, seed: str) -> DataFrame:
    """``docs`` with _size, _source, _target, _source_size and _copies beside its own columns; ``names``: id, text, source.

    Texts stay where they are: rows meet their source's target by a broadcast, or, where there are too many sources for
    one, in salted parts of a source.
    """
    id_col, text_col, source_col = names
    source = F.col(source_col).cast("string")
    sizes = docs.select(source.alias("source"), n_words(F.col(text_col)).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    found = materialize(source_targets(sizes.select("source", "source_size"), weights, share, max_repeats), "targets")
    key = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("null"))
    targets = found.select(key(F.col("source")).alias("_key"), F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    small = broadcast_if_small(targets)
    hot = None
    if small is targets:
        hot = hot_keys(sizes.select(key(F.col("source")).alias("_key"), "n"), ["_key"], docs.count())
    both = join_split(docs.withColumn("_key", key(source)), small, ["_key"], hot).drop("_key")
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    copies = F.least(F.floor(rate) + (draw(F.col(id_col).cast("long"), seed) < rate - F.floor(rate)).cast("long"), F.lit(max_repeats).cast("long"))
    return both.withColumns({"_size": n_words(F.col(text_col)), "_copies": copies})


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken; one row for each row of ``docs``.

    ``copies`` is how often the mix emits the document, ``taken`` the words it takes so, repeats
    counted. Reruns agree, whatever the partitions. Null texts have size 0; a null source is a
    source, last in order; documents of a source of size 0 get no copies; repeated ids draw
    alike. An empty table gives an empty result; other columns are ignored.
    """
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[source_col].alias("source"))
    found = _with_copies(own, ("doc_id", "text", "source"), weights, share, max_repeats, seed)
    return found.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source").alias("source"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"),
    )


def emit_mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as :func:`mix` says, all columns kept whatever their names."""
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.toDF(*own.values())
    found = _with_copies(renamed, (own[id_col], own[text_col], own[source_col]), weights, share, max_repeats, seed).filter("_copies > 0")
    each = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return each.select(*(F.col(renamed_as).alias(c) for c, renamed_as in own.items()))
