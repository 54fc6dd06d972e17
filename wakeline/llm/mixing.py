"""Mixing sources to target weights: capped water-filling and seeded repetitions, built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import masked, unmasked, written

WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the hash that name a bucket, at each of two levels; a running sum reads 16 ** DIGITS rows of a source.
DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """sources(_source, source_size, weight) with target.

    Targets share `share` of all sizes by weight, but none is above max_epochs times its source. The level L
    with sum(min(cap, weight * L)) = total is what repeated clamping and proportional resharing end at. By
    ascending cap / weight the clamped sources come first; after k clamped ones, L = (total - their caps) /
    the weights left, valid for the first k at which the next source isn't above its cap.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    order = W.orderBy((cap / F.col("weight")).asc(), F.col("_source").asc())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    s = sources.withColumns(
        {
            "_cap": cap,
            "_level": (
                F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
            )
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
        }
    )
    valid = F.col("_level") * F.col("weight") <= F.col("_cap")
    level = F.min_by("_level", F.when(valid, F.struct(cap / F.col("weight"), "_source"))).over(everything)
    target = F.least(F.col("_cap"), F.coalesce(level * F.col("weight"), F.col("_cap")))
    return s.withColumn("target", target).drop("_cap", "_level")


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: int = 42,
    size_col: str | None = None,
) -> DataFrame:
    """One row for each row of docs: its columns, then _size, _source_size, _target and _epochs (times the mix takes it).

    Sources in code-point order, null last, get `weights` in turn. A source is taken floor(target / size)
    times whole; what is left goes to its documents in the order of a seeded hash of the id, up to where the
    words are nearest the target. That point is found by summing hash buckets, then buckets of the bucket it
    falls in, and only then documents, so no task reads the documents of a hot source. Words are counted in one scan
    of the texts, of which a narrow table is kept; with size_col they are given (a null is 0) and no text is read.

    A null text has size 0 and takes part; null sources are one source; rows that repeat count each, and those of one
    id are taken alike (null ids are one id). Sources without words have target 0. An empty table gives no rows.
    Columns of docs may have any names, those of the result too.
    """
    rows, name = masked(docs)
    size = word_count(F.col(name[text_col])) if size_col is None else F.coalesce(F.col(name[size_col]), F.lit(0)).cast("long")
    place = F.md5(F.concat(F.coalesce(F.col(name[id_col]).cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    own = rows.withColumns(
        {
            "_size": size,
            "_hash": place,
            "_source": F.coalesce(F.concat(F.lit("="), F.col(name[source_col]).cast("string")), F.lit("")),
        }
    )
    # Buckets are prefixes, so hash order is bucket order.
    own = own.withColumns({"_b1": F.substring("_hash", 1, DIGITS), "_b2": F.substring("_hash", DIGITS + 1, DIGITS)})
    narrow = own.select("_source", "_b1", "_b2", "_hash", "_size")
    narrow = written(narrow) if size_col is None else narrow
    sizes = narrow.groupBy("_source", "_b1").agg(F.sum("_size").alias("_words"))
    sources = sizes.groupBy("_source").agg(F.sum("_words").alias("source_size"))
    # The key puts null first and sources in code-point order, so null is moved to the end.
    turn = F.row_number().over(W.orderBy((F.col("_source") == "").asc(), F.col("_source").asc())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights)).cast("int") + 1)
    sources = water_fill(sources.withColumn("weight", weight), share, max_epochs)
    sources = sources.withColumn(
        "_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    )
    sources = sources.withColumn("_need", F.col("target") - F.col("_whole") * F.col("source_size"))

    def crossing(parts: DataFrame, keys: list[str], part: str) -> DataFrame:
        """For each source the part in which the running sum of words passes _need, and what is needed there."""
        upto = F.sum("_words").over(W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1))
        return (
            parts.withColumn("_before", F.coalesce(upto, F.lit(0)))
            .filter("_before <= _need AND _need < _before + _words")
            .withColumn("_need", F.col("_need") - F.col("_before"))
            .select(*keys, part, "_need")
        )

    first = crossing(sizes.join(sources.select("_source", "_need"), "_source"), ["_source"], "_b1")
    second = narrow.join(first, ["_source", "_b1"]).groupBy("_source", "_b1", "_b2", "_need")
    second = crossing(second.agg(F.sum("_size").alias("_words")), ["_source", "_b1"], "_b2")
    inside = narrow.join(second, ["_source", "_b1", "_b2"]).groupBy("_source", "_b2", "_hash", "_need")
    inside = inside.agg(F.sum("_size").alias("_words"))
    # One hash is one id (or none): the last id is taken where that brings the source nearer to its target.
    run = W.partitionBy("_source", "_b2").orderBy("_hash").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = (
        inside.withColumn("_upto", F.sum("_words").over(run))
        .groupBy("_source", F.col("_b2").alias("_stop2"))
        .agg(F.max(F.when(F.col("_upto") - F.col("_words") / 2 <= F.col("_need"), F.col("_hash"))).alias("_last"))
    )
    plan = sources.join(first.select("_source", F.col("_b1").alias("_stop1")), "_source", "left")
    plan = plan.join(inside, "_source", "left")
    # One row for each source and bucket, so that the rows of a hot source meet the plan in many tasks.
    plan = sizes.select("_source", "_b1").join(plan, "_source")
    # Without a crossing the need is 0 (nothing more) or the whole source (its documents all once more).
    extra = (
        F.when(F.col("_need") <= 0, F.lit(False))
        .when(F.col("_stop1").isNull(), F.lit(True))
        .when(F.col("_b1") != F.col("_stop1"), F.col("_b1") < F.col("_stop1"))
        .when(F.col("_b2") != F.col("_stop2"), F.col("_b2") < F.col("_stop2"))
        .otherwise(F.coalesce(F.col("_hash") <= F.col("_last"), F.lit(False)))
    )
    return own.join(plan, ["_source", "_b1"]).withColumns(
        {
            "_epochs": (F.col("_whole") + extra.cast("long")).cast("long"),
            "_source_size": F.col("source_size").cast("long"),
            "_target": F.col("target"),
        }
    ).select(*unmasked(docs), "_size", "_source_size", "_target", "_epochs")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it, rows taken 0 times gone; same columns.

    Nulls, repeated rows, ties and empty tables as in mixture(); rows of null or empty text may repeat too.
    """
    m = mixture(docs, **options)
    last = m.columns[-1]
    m = m.toDF(*(f"c{i}" for i in range(len(m.columns) - 1)), last)
    times = F.explode(F.sequence(F.lit(1), F.col(last).cast("int")))
    return m.filter(F.col(last) > 0).withColumn("_copy", times).select(*unmasked(docs))
