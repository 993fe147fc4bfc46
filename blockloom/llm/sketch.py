"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions alone.

A sketch is the sorted array of the k least distinct hashes of a text's word shingles. Sketches of
parts merge into the sketch of the whole, and estimate resemblance, containment and the number of
distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.common import HOT_PARTS, materialize, row_key

K, WORDS = 128, 5
_WHITE = " \t\n\x0b\x0c\r"
_NONE = "array<bigint>"


def with_sketch(table: DataFrame, text_col: str, out: str, k: int = K, words: int = WORDS) -> DataFrame:
    """``table`` with the sketch of ``text_col`` as ``out`` (array<bigint>).

    Words are runs of anything but ``[\\x20\\x09-\\x0D]``, lower-cased; shingles are ``words`` of them,
    hashed by Spark's xxhash64; a shorter text is one shingle. Null, empty and blank texts have an
    empty sketch.
    """
    trimmed = F.btrim(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(_WHITE))
    cut = table.withColumn("_w", F.filter(F.split(trimmed, r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    w = F.col("_w")
    many = F.transform(F.sequence(F.lit(1), F.size(w) - (words - 1)), lambda i: F.xxhash64(F.slice(w, i, words)))
    hashes = F.when(F.size(w) >= words, many).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast(_NONE))
    return cut.withColumn("_h", hashes).drop("_w").withColumn(out, F.slice(F.array_sort(F.array_distinct("_h")), 1, k)).drop("_h")


def as_text(sketch: Column) -> Column:
    """The sketch as a string: 16 hex digits a hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard resemblance; exact if the union has at most k shingles; 1 for two empty sketches."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both.cast("double") / F.size(union))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(sketch, k).cast("double") + F.lit(float(1 << 63))) / F.lit(float(1 << 64))
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated part of a's shingles that b has too; 1 if a is empty."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    shared = resemblance(a, b, k) * distinct_shingles(union, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def merge_sketches(parts: DataFrame, key: str, sketch: str, k: int = K, fan_in: int = 256) -> DataFrame:
    """(key, sketch) of many parts to one sketch a key: the sketch of all their texts together.

    A key's parts are dealt over salts so that no task gathers more than about ``fan_in`` sketches
    at a time, however many parts one key has; rounds go on until one is left. Null sketches count
    as empty; a null key is a key.
    """
    now = parts.select(F.col(key).alias("_k"), F.coalesce(F.col(sketch), F.array().cast(_NONE)).alias("_s"))
    most = now.groupBy("_k").count().agg(F.max("count")).first()[0] or 0
    while most > 0:
        salts = -(-most // fan_in)
        dealt = now.withColumn("_d", F.pmod(F.xxhash64("_s"), F.lit(salts)) if salts > 1 else F.lit(0))
        now = dealt.groupBy("_k", "_d").agg(F.collect_set("_s").alias("_s")).select("_k", F.slice(F.array_sort(F.array_distinct(F.flatten("_s"))), 1, k).alias("_s"))
        most = salts if salts > 1 else 0
    return now.select(F.col("_k").alias(key), F.col("_s").alias(sketch))


def _at_most(array: Column, x: Column, most: int) -> Column:
    """How many of the sorted values of ``array``, at most ``most``, are at most ``x``: a binary search."""
    steps = F.sequence(F.lit(1), F.lit(max(1, most.bit_length())))

    def halve(s: Column, _: Column) -> Column:
        middle = ((s["lo"] + s["hi"]) / 2).cast("int")
        right = F.coalesce(F.get(array, middle) <= x, F.lit(False)) & (middle < s["hi"])
        return F.struct(F.when(right, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(F.greatest(s["lo"], F.least(middle, s["hi"]))).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.size(array).alias("hi"))
    return F.aggregate(steps, start, halve)["lo"]


def _numbers(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(_NONE) if values else F.array().cast(_NONE)


def with_next(dealt: DataFrame, columns: list[str]) -> DataFrame:
    """What :func:`dealt_by_range` returns, with next_<column>: the values of the next row, descending doc_id, in a ring.

    Null ids come last, ties go by ``rid``.
    """
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("rid").desc())
    nexts = [F.lead(c).over(order).alias(f"next_{c}") for c in columns]
    return dealt.select("*", *nexts).filter("guest = 0")


#: Ranges of ids that the driver cuts, and ranges that each is cut into by a table of one row each.
RANGES, FINER = 1024, 256


def _cuts(n: int) -> list[float]:
    return [i / n for i in range(1, n)]


def dealt_by_range(docs: DataFrame, rows_per_bucket: int = 2000, ranges: int = RANGES, finer: int = FINER) -> DataFrame:
    """``docs`` (doc_id, rid, text) with bucket, guest and copies, partitioned by bucket.

    Rows are dealt once, by ranges of doc_id, and those of an id that many rows share (or of no id) by ranges of rid
    besides; the first row of each bucket is also dealt, as a guest, to the bucket before it, so no window spans buckets
    and no task sees more than one. Rows alike in id and text are one row with that many ``copies`` where their id is hot,
    as no range would part them. The driver sees one id for each of at most ``ranges`` ranges; what is broadcast has a
    row a bucket, at most ``ranges`` * ``finer`` of them.
    """
    total, null_rows = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    n = max(1, -(-(total - null_rows) // rows_per_bucket))
    first, second = min(n, ranges), min(finer, -(-n // ranges))
    least = max(4 * rows_per_bucket, total // HOT_PARTS)
    hot = [(r["doc_id"], r["n"]) for r in docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") > least).collect()]
    parts = {i: -(-n // least) for i, n in hot}
    cuts = docs.filter(~F.col("doc_id").isin(list(parts))).agg(F.percentile_approx("doc_id", _cuts(first), 20 * first)).first()[0] if first > 1 else []
    salts = max([1, *parts.values(), -(-null_rows // least)])
    # a hot id is a range by itself
    bounds = sorted({*(cuts or []), *parts, *(i + 1 for i in parts if i < (1 << 63) - 1)})
    rows = docs.withColumn("copies", F.lit(1).cast("long"))
    if parts or null_rows > least:
        is_hot = F.col("doc_id").isin(list(parts)) | F.col("doc_id").isNull() if null_rows > least else F.col("doc_id").isin(list(parts))
        one = docs.filter(is_hot).groupBy("doc_id", "rid").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
        rows = rows.filter(~F.coalesce(is_hot, F.lit(False))).unionByName(one)
    own = rows.withColumn("at", _at_most(_numbers(bounds), F.col("doc_id"), len(bounds)).cast("long"))
    if second > 1:
        # one row a range, of bounded size
        more = own.filter("doc_id IS NOT NULL").groupBy("at").agg(F.array_sort(F.array_distinct(F.percentile_approx("doc_id", _cuts(second), 20 * second))).alias("fine"))
        own = own.join(F.broadcast(more), "at", "left")
        own = own.withColumn("at", F.col("at") * second + F.coalesce(_at_most(F.col("fine"), F.col("doc_id"), second), F.lit(0))).drop("fine")
    # the part of an id's rows that a hash falls in, in order
    place = (F.col("rid").cast("double") + F.lit(float(1 << 63))) / F.lit(float(1 << 64))
    chosen = F.create_map(*(F.lit(x) for pair in parts.items() for x in pair)) if parts else F.create_map().cast("map<bigint,int>")
    of_id = F.when(F.col("doc_id").isNull(), F.lit(-(-null_rows // least) or 1)).otherwise(F.coalesce(F.try_element_at(chosen, F.col("doc_id")), F.lit(1)))
    part = F.least(F.floor(place * of_id), of_id - 1).cast("long")
    bucketed = own.withColumn("bucket", F.coalesce(F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.col("at")), F.lit(-1)) * salts + part).drop("at")
    firsts = materialize(bucketed.groupBy("bucket").agg(F.max(F.struct("doc_id", "rid")).alias("f")), "firsts")
    before = F.coalesce(F.lag("bucket").over(Window.orderBy(F.col("bucket").desc())), F.lit(firsts.agg(F.min("bucket")).first()[0]))
    g = F.broadcast(firsts.select(F.col("f.doc_id").alias("g_id"), F.col("f.rid").alias("g_rid"), before.alias("to")))
    both = bucketed.join(g, (bucketed["rid"] == g["g_rid"]) & bucketed["doc_id"].eqNullSafe(g["g_id"]), "left")
    home, away = F.struct("bucket", F.lit(0).alias("guest")), F.struct(F.col("to").alias("bucket"), F.lit(1).alias("guest"))
    seats = both.withColumn("seat", F.explode(F.when(F.col("to").isNull(), F.array(home)).otherwise(F.array(home, away))))
    return seats.select("doc_id", "rid", "text", "copies", "seat.bucket", "seat.guest").repartition("bucket")


def fingerprints(docs: DataFrame, k: int = K, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sketch (array<bigint>), fingerprint (its hex), n_shingles (estimated); one row for each row of ``docs``."""
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return with_sketch(own, "text", "sketch", k, words).select("doc_id", "sketch", as_text(F.col("sketch")).alias("fingerprint"), distinct_shingles(F.col("sketch"), k).alias("n_shingles"))


def edited_fingerprints(docs: DataFrame, k: int = K, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; a row for each row of ``docs``.

    The edited text has its last floor(n_chars/3) code points replaced by the first as many of the
    next document's, descending doc_id, the first following the last. A null text is empty; null
    ids come last; repeated ids go by a hash of the row; identical rows follow each other. A
    single document follows itself; an empty table gives an empty result; other columns are ignored.
    """
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    seated = with_sketch(dealt_by_range(own.withColumn("rid", row_key())), "text", "sketch", k, words)
    paired = with_next(seated, ["text", "sketch"]).withColumn("n_chars", F.char_length("text"))
    m = F.floor(F.col("n_chars") / 3).cast("int")
    # of copies dealt as one, each but the last is followed by its like
    turns = F.filter(F.array(F.struct(F.lit(False).alias("like"), F.lit(1).cast("long").alias("times")), F.struct(F.lit(True).alias("like"), (F.col("copies") - 1).alias("times"))), lambda t: t["times"] > 0)
    paired = paired.withColumn("turn", F.explode(turns))
    for c in ("text", "sketch"):
        paired = paired.withColumn(f"next_{c}", F.when(F.col("turn.like"), F.col(c)).otherwise(F.col(f"next_{c}")))
    edited = paired.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - m), F.substring("next_text", F.lit(1), m)))
    done = with_sketch(edited.drop("text", "next_text"), "edited", "edited_sketch", k, words)
    found = done.select(
        F.col("turn.times").alias("times"),
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times", "_copy")
