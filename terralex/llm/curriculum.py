"""Mixing sources to target weights: a curriculum that changes over training.

Sources by code point, null last, weigh ``WEIGHTS`` in turn and share ``SHARE`` times all words; none gives more than
``REPEATS`` times its own words, and what such sources can't give is shared anew by weight. Each source gives its words as a stream: its documents in an
order that their content fixes, then all of them again. The stream ends at the source's target, in the middle of a document if need be.

When a word of the stream is used follows from the source's schedule, a weight over training time from 0 to 1 (knots with lines
between them). Its integral, scaled to the target, is the demand up to a time; the inverse gives the time at which a
document's first word is due. Documents of all sources in the order of these times are the training order, and a running
sum of their words gives each its position.

Running sums are taken in buckets, about as many as the square root of the number of documents, so that neither a bucket's rows nor the
table of buckets grows as the documents do; a source with a third of all rows is spread over all buckets. Only numbers move, no texts
but in ``arranged``. All of it is DataFrame functions.

Defined results: a null or empty text has size 0 and is never taken. Null is a source of its own. Rows that are equal in doc_id and
text are interchangeable: each is one row of the result, and which of them the end of the stream cuts makes no difference. Other columns are not read. No documents give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralex.llm.common import free_name, numbered, text_of, written

WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
Knots = Sequence[tuple[float, float]]
#: Schedules, given to the sources in turn as the weights are: one fades out, one stays, one comes in.
SCHEDULES: tuple[Knots, ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
WORD = r"[^\x20\x09-\x0D]+"


def _in_turn(values: Sequence[float], place: Column) -> Column:
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), (place % len(values) + 1).cast("int"))


def _offsets(sums: DataFrame, by: list[str], value: str) -> Column:
    """The sum of the buckets before each, per key; sums has a row per key and bucket."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def sized(docs: DataFrame, row: str | None = None) -> DataFrame:
    """Written: row, doc_id, named (the source with a mark before it, which sorts null last), size, key (content decides it), bucket.

    row: the column that numbers the rows, if docs has one."""
    text = text_of()
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text))
    slim = docs.select(
        (F.monotonically_increasing_id() if row is None else F.col(row)).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("-")).alias("named"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        key.alias("key"),
    )
    found = written(slim, "sizes")
    buckets = max(1, ceil(sqrt(found.count())))
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint")
    return found.withColumn("bucket", F.floor(place * buckets / F.lit(1 << 32)).cast("int"))


def ranked(sources: DataFrame) -> DataFrame:
    """Written: sources with rank, their place by code point from 0. Each part of a range sort counts its own; the parts' counts are added."""
    parts = sources.repartitionByRange("named").sortWithinPartitions("named").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    parts = written(parts, "ranked")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    counts = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    return parts.join(counts, "part").select("named", "source_size", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("rank"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """sizes (named, size) -> named, source_size, rank, target: what each source gives, in words.

    Sources whose weighted share is above ``repeats`` times their size give that much, and the rest is shared anew, until none is above: a small
    job on the table of sources for each round, of which one row of sums reaches the driver."""
    sources = written(ranked(sizes.groupBy("named").agg(F.sum("size").alias("source_size"))).withColumn("weight", _in_turn(weights, F.col("rank"))), "sources")
    most = F.col("source_size") * repeats
    level, before = 0.0, None
    while True:
        full = most <= F.col("weight") * F.lit(level)
        now = sources.agg(
            F.sum("source_size").alias("words"), F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, most)).alias("given"), F.sum(F.when(~full, F.col("weight"))).alias("weights")
        ).first()
        if now["n"] == before or not now["weights"]:
            return sources.select("named", "source_size", "rank", F.when(full | F.lit(not now["weights"]), most.cast("double")).otherwise(F.col("weight") * F.lit(level)).alias("target"))
        level, before = (share * now["words"] - (now["given"] or 0)) / now["weights"], now["n"]


def _due(part: Column, knots: Knots) -> Column:
    """The time at which this part of the whole demand is reached: the inverse of the schedule's integral."""
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        if min(w0, w1) < 0 or t1 < t0:
            raise ValueError("weights of a schedule are 0 or more, its times in order")
        area = (t1 - t0) * (w0 + w1) / 2
        if area > 0:
            pieces.append((total, total + area, t0, w0, (w1 - w0) / (t1 - t0)))
            total += area
    if not pieces:
        raise ValueError("a schedule needs some weight")
    out = F.lit(float(knots[-1][0]))
    for begin, end, t0, w0, slope in reversed(pieces):
        area = F.greatest(F.lit(0.0), part * total - begin)
        time = t0 + 2 * area / (w0 + F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * area)))
        out = F.when(part * total < end, F.when(area > 0, time).otherwise(F.lit(float(t0)))).otherwise(out)
    return out


def appearances(docs: DataFrame, goals: DataFrame, schedules: Sequence[Knots] = SCHEDULES, repeats: int = REPEATS) -> DataFrame:
    """docs as of sized() -> row, doc_id, key, epoch, words (taken of it in that epoch), time: a row for each time that a document is used."""
    sums = docs.groupBy("named", "bucket").agg(F.sum("size").alias("total"))
    sums = sums.select("named", "bucket", _offsets(sums, ["named"], "total").alias("before")).join(goals, "named").withColumn("demand", F.floor("target").cast("long"))
    inside = Window.partitionBy("named", "bucket").orderBy("key", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    streams = docs.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["named", "bucket"])
    streams = streams.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("start", F.col("before") + F.col("own") + F.col("epoch") * F.col("source_size"))
    taken = F.greatest(F.lit(0), F.least(F.col("size"), F.col("demand") - F.col("start")))
    used = streams.withColumn("words", taken.cast("long")).filter("words > 0")
    part, time = F.col("start") / F.col("demand"), None
    for k, knots in enumerate(schedules):
        due = _due(part, knots)
        time = F.when(F.col("rank") % len(schedules) == k, due) if time is None else time.when(F.col("rank") % len(schedules) == k, due)
    return used.select("row", "doc_id", "named", "key", "epoch", "words", time.alias("time"))


def training_order(docs: DataFrame, goals: DataFrame, schedules: Sequence[Knots] = SCHEDULES, repeats: int = REPEATS) -> DataFrame:
    """Written in order of position: row, doc_id, epoch, words, time, position (words used before). docs as of sized()."""
    used = written(appearances(docs, goals, schedules, repeats), "appearances")
    first, last = (float(f(k[i][0] for k in schedules)) for f, i in ((min, 0), (max, -1)))
    buckets = max(1, ceil(sqrt(used.count())))
    place = F.floor((F.col("time") - first) / (last - first) * buckets)
    used = used.withColumn("bucket", F.least(F.lit(buckets - 1), F.greatest(F.lit(0), place)).cast("int"))
    sums = used.groupBy("bucket").agg(F.sum("words").alias("total"))
    sums = sums.select("bucket", _offsets(sums, [], "total").alias("before"))  # a row per bucket
    inside = Window.partitionBy("bucket").orderBy("time", "named", "epoch", "key", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = used.withColumn("own", F.coalesce(F.sum("words").over(inside), F.lit(0))).join(sums, "bucket")
    placed = placed.select("row", "doc_id", "epoch", "words", "time", (F.col("before") + F.col("own")).cast("long").alias("position"))
    return written(placed.repartitionByRange("position").sortWithinPartitions("position"), "training-order")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, schedules: Sequence[Knots] = SCHEDULES) -> DataFrame:
    """A row per document: doc_id, size, source_size, target (its source's), taken (its words in the training order, repeats counted)."""
    docs = sized(docs)
    goals = written(targets(docs, weights, share, repeats), "targets")
    taken = training_order(docs, goals, schedules, repeats).groupBy("row").agg(F.sum("words").alias("taken"))
    # The targets meet buckets, not rows, so a large source isn't one key of a join.
    spread = docs.select("named", "bucket").distinct().join(goals, "named").select("named", "bucket", "source_size", "target")
    return docs.join(taken, "row", "left").join(spread, ["named", "bucket"]).select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def arranged(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, schedules: Sequence[Knots] = SCHEDULES) -> DataFrame:
    """The mix itself: columns of documents, with epoch, taken words and position (names that docs has get a ``_``), range-sorted by position."""
    rows, row = numbered(docs)
    slim = sized(rows, row)
    order = training_order(slim, written(targets(slim, weights, share, repeats), "targets"), schedules, repeats)
    names = {c: free_name(docs, c) for c in ("epoch", "words", "position")}
    used = order.select(F.col("row").alias(row), *(F.col(c).alias(n) for c, n in names.items()))
    return rows.join(used, row).drop(row).repartitionByRange(names["position"]).sortWithinPartitions(names["position"])
