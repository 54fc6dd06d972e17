"""Exact dedup by progressive refinement, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import body, masked, small, unmasked, written


def _several(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys that several rows have; counted with a map-side combine."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*keys)


def _shape(text: Column, prefix: int) -> dict[str, Column]:
    """What the two levels of refinement group by: the length in bytes and a hash of the first `prefix` characters."""
    return {"_n_bytes": F.octet_length(text), "_head": F.xxhash64(F.substring(text, 1, prefix))}


def _heads(shapes: DataFrame) -> DataFrame:
    """(_n_bytes, _head) that several rows have, found among rows whose length several have; a written table."""
    return written(_several(shapes.join(small(written(_several(shapes, "_n_bytes"))), "_n_bytes", "left_semi"), "_n_bytes", "_head"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 128) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts form a group; the row with the largest id stays. Refinement is progressive: rows whose length
    no other has are alone, then rows whose (length, prefix hash) no other has, and only the rest are grouped by
    the full hash. The digest is a column of the result, so the one scan of the texts takes it for every row; that
    scan is written as a narrow table, and texts are never shuffled. Lone rows don't enter the last join. Grouping
    combines on the map side, so a group of any size is one row for each task; the small side of a join is
    broadcast only within a counted bound, and a hot key in a shuffle join is split by Spark's skew handling.

    Nulls: a null text counts as empty; a null id sorts below every other, so it stays only where its group
    has no other id (keep_id null, kept true). Repeated rows with one id and one text count in group_size and
    are all kept or all dropped. An empty table gives no rows. Other columns, whatever their names, don't matter.
    """
    text = body(text_col)
    d = written(docs.select(F.col(id_col).alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), *(c.alias(n) for n, c in _shape(text, prefix).items())))
    level = ["_n_bytes", "_head"]
    heads = small(_heads(d))
    alone = d.join(heads, level, "left_anti")
    groups = d.join(heads, level, "left_semi").groupBy(*level, "text_sha256")
    # Written, so that Spark can split a hot text in the join back.
    groups = written(groups.agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    columns = ["doc_id", "keep_id", "group_size", F.col("keep_id").eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256"]
    met = d.join(heads, level, "left_semi").join(groups, [*level, "text_sha256"])
    lone = alone.withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")})
    return lone.select(*columns).unionByName(met.select(*columns))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 128) -> DataFrame:
    """docs with one row for each text, that with the largest id; same columns.

    Rows that refinement finds alone pass without a shuffle where the surviving (length, prefix hash) pairs are few
    enough to be broadcast (BROADCAST_ROWS), else after one. Only the others have their full text hashed: each task
    keeps its best row for each hash (Spark's limit of ranked windows), then one row stays. Of rows with one id and
    one text any one stays. A null text counts as empty, a null id as smallest. An empty table gives no rows.
    """
    rows, name = masked(docs)
    text, level = body(name[text_col]), ["_n_bytes", "_head"]
    d = rows.withColumns(_shape(text, prefix))
    heads = small(_heads(written(d.select(*level))))
    best = W.partitionBy(*level, "_full").orderBy(F.col(name[id_col]).desc_nulls_last())
    copies = (
        d.join(heads, level, "left_semi")
        .withColumn("_full", F.sha2(text.cast("binary"), 256))
        .withColumn("_rank", F.row_number().over(best))
        .filter("_rank = 1")
    )
    return d.join(heads, level, "left_anti").select(*unmasked(docs)).unionByName(copies.select(*unmasked(docs)))
