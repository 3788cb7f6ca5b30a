"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key ``-ln(u) / quality``; small keys go first.
A source whose target is e full sizes and a rest takes all its documents e times
(complete epochs) and then, in key order, whole documents up to the rest: the
document at the edge is taken if that brings the sum nearer to the target.

Keys are cut into ``BUCKETS`` ranges.  Sums per (source, range) place every range
before, after or at the edge of its source; only documents of the edge ranges are
sorted, so no source is ever gathered in one task.

Targets: sources by code point, null last, weigh ``weights`` in turn and share
``budget`` times all sizes; a target stops at ``most`` times its source's size and
the excess is shared again by weight until none is above.

Cases: null text has size 0; sources and tables without words get target 0;
a null source is a source; equal keys (repeated rows) are ordered by id and then
arbitrarily among equals; reruns give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm.texts import share
from slotwise.session import materialise

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2
BUCKETS = 1 << 14
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words: one mark is left of each."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, WORD, "x"), r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("bigint")


def quality(text: Column, size: Column) -> Column:
    """From 0.25 to 1: highest where the mean word has five letters, falling by the ratio either way."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    ratio = F.greatest(mean, F.lit(1.0)) / 6
    return 0.25 + 0.75 * F.coalesce(F.least(ratio, 1 / ratio), F.lit(0.0))


def exponential_key(text: Column, key: Column, weight: Column) -> Column:
    u = F.greatest(share(key, text, F.lit(5)), F.lit(2.0 ** -54))
    return -F.log(u) / weight


def bucket_of(k: Column) -> Column:
    """Range of a key: keys of weights from 0.25 to 1 spread over all ranges."""
    return F.least(F.floor((1 - F.exp(-k * 0.5)) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def _numbered(sources: DataFrame) -> DataFrame:
    """Rows in order of source with their position ``i``, numbered range by range."""
    ranged = materialise(sources.repartitionByRange(F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    here = Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")
    return ranged.join(F.broadcast(starts), "part").select("source", "source_size", (F.col("start") + F.row_number().over(here) - 1).alias("i"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """``source``, ``source_size`` and ``target`` for the rows (source, source_size), one per source."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    rows = materialise(_numbered(sizes).withColumn("weight", weight), "weights")
    cap = F.col("source_size") * float(most)
    pool, all_weights, top = rows.agg(F.sum("source_size"), F.sum("weight"), F.sum(cap)).first()
    pool = budget * (pool or 0)
    rate = pool / all_weights if all_weights else 0.0
    # Each turn shares what the sources at their limit leave among the others; the rate only grows.
    while pool and pool < top:
        full, open_weights = rows.agg(F.sum(F.when(cap <= rate * F.col("weight"), cap)), F.sum(F.when(cap > rate * F.col("weight"), F.col("weight")))).first()
        if not open_weights:
            break
        raised = (pool - (full or 0.0)) / open_weights
        if raised <= rate:
            break
        rate = raised
    return rows.select("source", "source_size", F.least(cap, F.lit(float(rate)) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", keep: list[str] | None = None,
        weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """``row`` (the kept columns), ``size``, ``source_size``, ``target`` and ``taken`` (words, repeats counted) for every document."""
    words = size_of(F.col("text"))
    sized = (docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"),
                         F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{key}`").alias("key"))
             .withColumn("size", words).withColumn("k", exponential_key(F.col("text"), F.col("key"), quality(F.col("text"), F.col("size"))))
             .select("row", "source", "key", "size", "k", bucket_of(F.col("k")).alias("bucket")))
    sized = materialise(sized, "sized")
    sums = materialise(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "sums")
    goals = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, most)
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)) \
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # The edge range is the one in which the running sum of a source passes the rest.
    running = Window.partitionBy("source").orderBy("bucket")
    edge = (sums.withColumn("upto", F.sum("words").over(running)).join(goals.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name")))
            .filter(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before")), "bucket").alias("edge")))
    plan = materialise(goals.join(edge.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name")), "left")
                       .select(F.col("source").alias("name"), "source_size", "target", "epochs", "rest", "edge"), "plan")
    both = sized.join(plan, F.col("source").eqNullSafe(F.col("name")))
    past = F.coalesce(F.col("bucket") < F.col("edge.bucket"), F.lit(True))
    at_edge = F.coalesce(F.col("bucket") == F.col("edge.bucket"), F.lit(False))
    out = ["row", "size", "source_size", "target"]
    whole = both.filter(~at_edge).select(*out, (F.col("size") * (F.col("epochs") + past.cast("int"))).cast("bigint").alias("taken"))
    inside = Window.partitionBy("source").orderBy("k", "key")
    upto = F.col("edge.before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    close = (upto - F.col("size") / 2 <= F.col("rest")).cast("int")
    cut = both.filter(at_edge).withColumn("more", close).select(*out, (F.col("size") * (F.col("epochs") + F.col("more"))).cast("bigint").alias("taken"))
    return whole.unionByName(cut)
