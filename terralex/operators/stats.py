"""Counts of tags, their rankings, and facets. Counts are partial aggregates; each ranking ends in a top-k."""

from __future__ import annotations

from collections.abc import Iterable
from math import ceil

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from terralex.sources.scratch import remove, written

#: Tags in a block of a ranking that the driver holds, at most.
MOST = 10_000
#: Rows of a task that groups tags by item: so few up to that many tasks (Spark streams rows to the files of up to 200 and sorts them for more), then up to so many.
FEW, STREAMED, MANY = 200_000, 200, 1_500_000


def pair_counts(tags: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """k, v, n: tags of the items (of all, or of those in among)."""
    own = tags if among is None else tags.join(among.select("item_id").distinct(), "item_id", "left_semi")
    return own.groupBy("k", "v").agg(F.count("*").alias("n"))


def key_counts(pairs: DataFrame) -> DataFrame:
    """k, n (an item counts once for each value), n_values."""
    return pairs.groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("n_values"))


def without(counts: DataFrame, keys: Iterable[str] = (), prefixes: Iterable[str] = (), pairs: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """Counts but for these keys, keys that begin so, and pairs of key and value."""
    for key in keys:
        counts = counts.filter(F.col("k") != key)
    for prefix in prefixes:
        counts = counts.filter(~F.col("k").startswith(prefix))
    for k, v in pairs:
        counts = counts.filter((F.col("k") != k) | (F.col("v") != v))
    return counts


def most() -> Column:
    return -F.col("n")


def closest_to(threshold: int) -> Column:
    """Splits best: the count that is nearest to the threshold."""
    return F.abs(F.col("n") - threshold)


def top(counts: DataFrame, k: int, rank: Column | None = None) -> DataFrame:
    """The k first keys or pairs; ties by key, then value."""
    return counts.orderBy(most() if rank is None else rank, *(c for c in ("k", "v") if c in counts.columns)).limit(k)


def top_values(pairs: DataFrame, k: int, rank: Column | None = None) -> DataFrame:
    """The k first values of each key."""
    order = Window.partitionBy("k").orderBy(most() if rank is None else rank, "v")
    return pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def values_of(pairs: DataFrame, key: str, k: int, rank: Column | None = None) -> DataFrame:
    """The k first values of one key: k, v, n."""
    return top(pairs.filter(F.col("k") == key), k, rank)


def item_sets(tags: DataFrame, rows: int) -> DataFrame:
    """item_id, own: the different tags (k, v) of each item. rows: how many rows tags has at most; the tasks that group them follow it, so none holds more as tags grow."""
    tasks = max(tags.sparkSession.sparkContext.defaultParallelism, min(STREAMED, ceil(rows / FEW)), ceil(rows / MANY))
    return tags.filter("item_id IS NOT NULL").select("item_id", "k", "v").repartition(tasks, "item_id").groupBy("item_id").agg(F.collect_set(F.struct("k", "v")).alias("own"))


def _each(sets: DataFrame) -> DataFrame:
    """A row for each tag of a set, which stays beside it as own."""
    return sets.select("own", F.explode("own").alias("tag")).select("own", "tag.*")


def _other(own: DataFrame, *more: str) -> DataFrame:
    """Each tag with each of its item's tags as k2, v2."""
    return own.select("k", "v", *more, F.explode("own").alias("tag")).select("k", "v", *more, F.col("tag.k").alias("k2"), F.col("tag.v").alias("v2"))


def _shared(sets: DataFrame, among: DataFrame) -> DataFrame:
    """k, v, k2, v2, n of overlaps(), for tags of among."""
    among = among.select("k", "v")
    both = _other(_each(sets).join(among, ["k", "v"], "left_semi")).filter(F.struct("k", "v") < F.struct("k2", "v2"))
    return both.join(among.toDF("k2", "v2"), ["k2", "v2"], "left_semi").groupBy("k", "v", "k2", "v2").agg(F.count("*").alias("n"))


def overlaps(tags: DataFrame, among: DataFrame) -> DataFrame:
    """k, v, k2, v2, n: items with both, for pairs of tags in among (k, v), of any size (a small one should be marked for broadcast, or all tags are sorted by k and v); (k, v) sorts first."""
    own = tags.join(among.select("k", "v"), ["k", "v"], "left_semi")
    return _other(_each(item_sets(own, tags.count()))).filter(F.struct("k", "v") < F.struct("k2", "v2")).groupBy("k", "v", "k2", "v2").agg(F.count("*").alias("n"))


def clashes(sets: DataFrame, pairs: DataFrame, some: DataFrame) -> DataFrame:
    """k, v, n, k2, v2, n2: tags of some (k, v, n), a bounded ranking, and all tags that share more than a 200th of both tags' items with them. sets: item_sets()."""
    own = _each(sets).join(F.broadcast(some), ["k", "v"])
    shared = _other(own, "n").filter("k <> k2 OR v <> v2").groupBy("k", "v", "n", "k2", "v2").agg(F.count("*").alias("shared"))
    return shared.join(pairs.toDF("k2", "v2", "n2"), ["k2", "v2"]).filter("200 * shared > n + n2")


def _place(n: Column, k: Column, v: Column) -> Column:
    """What the ranking sorts by."""
    return F.struct((-n).cast("long").alias("rank"), k.alias("k"), v.alias("v"))


def _behind(pairs: DataFrame, last: Row | None) -> DataFrame:
    """The pairs that come after last in the ranking."""
    return pairs if last is None else pairs.filter(_place(F.col("n"), F.col("k"), F.col("v")) > _place(*(F.lit(last[c]) for c in ("n", "k", "v"))))


def _first_two(sets: DataFrame, pairs: DataFrame, candidates: int) -> list[Row]:
    """The first tag that hardly shares items with one before it, behind the first such one; ranked tags are taken in blocks that grow up to ``MOST``."""
    spark, size, before, last = sets.sparkSession, candidates, 0, None
    while block := top(_behind(pairs, last), size).collect():
        earlier = clashes(sets, pairs, spark.createDataFrame(block, pairs.schema)).filter(_place(F.col("n2"), F.col("k2"), F.col("v2")) < _place(F.col("n"), F.col("k"), F.col("v")))
        held = {(r["k"], r["v"]): r["held"] for r in earlier.groupBy("k", "v").agg(F.count("*").alias("held")).collect()}
        late = next((r for i, r in enumerate(block, before) if held.get((r["k"], r["v"]), 0) < i), None)
        if late is not None:
            clash = clashes(sets, pairs, spark.createDataFrame([late], pairs.schema)).select(F.col("k2").alias("k"), F.col("v2").alias("v"))
            return [top(pairs.join(clash, ["k", "v"], "left_anti"), 1).first(), late]
        size, before, last = min(2 * size, MOST), before + len(block), block[-1]
    return []


def disjoint_top(tags: DataFrame, k: int, candidates: int = 200) -> list[tuple[str, str, int]]:
    """Up to k pairs of tags, frequent ones first, any two of which share at most a 200th of their items together; none if there are no two such.

    The first two are found in the ranking of all tags. Then blocks of ``candidates`` tags that don't clash with the chosen ones are taken from it until k
    are chosen or no tags are left; the driver picks in a block. Tags are grouped by item once, in a scratch table."""
    spark, pairs, sets = tags.sparkSession, pair_counts(tags).persist(), None
    try:
        sets = written(item_sets(tags, pairs.agg(F.sum("n")).first()[0] or 0), "item-sets")
        chosen = _first_two(sets, pairs, candidates)
        last = chosen[-1] if chosen else None
        while chosen and len(chosen) < k:
            clash = clashes(sets, pairs, spark.createDataFrame(chosen, pairs.schema)).select(F.col("k2").alias("k"), F.col("v2").alias("v"))
            block = top(_behind(pairs, last).join(clash, ["k", "v"], "left_anti"), candidates).collect()
            if not block:
                break
            shared = {frozenset(((r["k"], r["v"]), (r["k2"], r["v2"]))): r["n"] for r in _shared(sets, F.broadcast(spark.createDataFrame(block, pairs.schema))).collect()}
            own = []
            for r in block:
                if all(200 * shared.get(frozenset(((r["k"], r["v"]), (c["k"], c["v"]))), 0) <= r["n"] + c["n"] for c in own):
                    own.append(r)
            chosen, last = chosen + own, block[-1]
        return [(r["k"], r["v"], r["n"]) for r in chosen[:k]]
    finally:
        pairs.unpersist()
        if sets is not None:
            remove(sets)


def facets(tags: DataFrame, keys: int, values: int) -> DataFrame:
    """k, v, n, place: of the keys with the most frequent pairs, the most frequent values."""
    pairs = pair_counts(tags)
    best = top(pairs.groupBy("k").agg(F.max("n").alias("n")), keys).select("k")
    return top_values(pairs.join(F.broadcast(best), "k", "left_semi"), values)
