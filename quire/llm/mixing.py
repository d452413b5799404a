"""Mixing sources to target weights by systematic sampling.

The size of the mix is the largest at which no source with a target needs a document more often than
its cap allows. Each document of a source is then expected ``e`` times (e = wanted tokens / tokens of the
source). Within a source the documents are ordered by size and a hash of their id, expected copies
are prefix-summed, one random offset in [0, 1) is added, and a copy is emitted for every integer that
a document's interval crosses. As neighbours in that order are about equally long, the tokens reached
lie close to the tokens wanted.

The prefix sum never gathers a source in one task: documents are range-partitioned by (source, size,
hash), each partition counts its documents per source, and the small table of counts (partitions x
sources with a target) gives each partition its starting rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut


def plan_mix(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source of either table: what it has, what it should give, and ``expected`` copies a document.

    ``sizes``: (doc_id, source, n_tokens); ``targets``: (source, target_share, max_repeats). A target
    whose source has no tokens cannot be met: the other targets are scaled up to a sum of 1
    (``planned_share``). Sources without a target, a null source, and documents of 0 tokens have
    0 expected copies. Repeated rows of a target count once (largest share and cap).
    """
    have = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").cast("double").alias("source_tokens"))
    want = targets.filter("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    both = have.join(want, "source", "full").fillna(0.0, ["source_tokens", "target_share"]).fillna(0, ["n_docs", "max_repeats"])
    usable = (F.col("source_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    every = Window.partitionBy(F.lit(1))  # a row per source
    return (
        both.withColumn("planned_share", F.when(usable, F.col("target_share")).otherwise(0.0) / F.nullif(F.sum(F.when(usable, F.col("target_share"))).over(every), F.lit(0.0)))
        .withColumn("planned_share", F.coalesce("planned_share", F.lit(0.0)))
        .withColumn("mix_tokens", F.coalesce(F.min(F.when(F.col("planned_share") > 0, F.col("max_repeats") * F.col("source_tokens") / F.col("planned_share"))).over(every), F.lit(0.0)))
        .withColumn("expected", F.when(F.col("planned_share") > 0, F.least(F.col("max_repeats").cast("double"), F.col("planned_share") * F.col("mix_tokens") / F.col("source_tokens"))).otherwise(0.0))
    )


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """``(copies, shares)`` of a mix.

    ``copies``: (doc_id, source, n_tokens, copies) of every document, also those with 0 copies.
    ``shares``: (source, target_share, planned_share, actual_share, max_repeats, most_copies, n_docs,
    n_copies, n_tokens) of every source; an empty mix has actual shares of 0.
    """
    sizes = cut(sizes)  # counting the tokens is the dear part
    plan = cut(plan_mix(sizes, targets))
    order = F.xxhash64(F.lit(seed), "doc_id")
    ranged = cut(sizes.withColumn("_h", order).repartitionByRange(F.col("source"), F.col("n_tokens"), F.col("_h"), F.col("doc_id")).withColumn("_part", F.spark_partition_id()))
    live = F.coalesce(F.col("n_tokens"), F.lit(0)) > 0
    counts = ranged.filter(live).groupBy("source", "_part").count()
    before = counts.withColumn("_before", F.coalesce(F.sum("count").over(Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    local = F.row_number().over(Window.partitionBy("_part", "source").orderBy("n_tokens", "_h", "doc_id"))
    numbered = ranged.filter(live).withColumn("_rank", local).join(before, ["source", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_before") - 1)
    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), "source"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    drawn = (
        numbered.join(plan.filter("expected > 0").select("source", "expected"), "source")
        .withColumn("copies", (F.floor(offset + F.col("expected") * (F.col("_rank") + 1)) - F.floor(offset + F.col("expected") * F.col("_rank"))).cast("int"))
        .filter("copies > 0")
        .select("doc_id", "source", "n_tokens", "copies")
    )
    drawn = cut(drawn)
    none = sizes.join(drawn.select("doc_id"), "doc_id", "left_anti").select("doc_id", "source", "n_tokens", F.lit(0).alias("copies"))
    copies = drawn.unionByName(none)
    got = drawn.groupBy("source").agg(F.sum("copies").alias("n_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"), F.max("copies").alias("most_copies"))
    every = Window.partitionBy(F.lit(1))
    shares = (
        plan.join(got, "source", "left")
        .fillna(0, ["n_copies", "n_tokens", "most_copies"])
        .withColumn("actual_share", F.coalesce(F.col("n_tokens") / F.nullif(F.sum("n_tokens").over(every), F.lit(0)), F.lit(0.0)))
        .select("source", "target_share", "planned_share", "actual_share", "max_repeats", "most_copies", "n_docs", "n_copies", "n_tokens")
    )
    return copies, shares
