"""A bounded, reproducible sample of labelled texts for fitting a classifier on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo the divisor; null ids give null."""
    return F.crc32(id_col.cast("string")) % divisor


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: tuple[int, int], most_chars: int) -> tuple[list[tuple[str, int]], float]:
    """At most ``per_class`` (text, label) pairs of label 0 and of label 1, and the share of label 1 among all labelled ids.

    ``learn`` says which ids may be used.  The rows come in the order of a hash
    of the id; ids with two different labels take the larger, of several texts of
    an id the least counts, texts longer than ``most_chars`` are passed over.  Only the chosen ids' texts move, and the
    join is with at most a quarter more ids than rows are asked for.
    """
    known = labels.filter(learn & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    chosen = reduce(DataFrame.unionByName, (known.filter(F.col("y") == y).orderBy(order, "doc_id").limit(per_class[y] * 5 // 4) for y in (0, 1)))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter(F.char_length(F.coalesce("text", F.lit(""))) <= most_chars)
    one = texts.groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = one.orderBy(order, "doc_id").select("text", "y").collect()
    kept: dict[int, list[tuple[str, int]]] = {0: [], 1: []}
    for r in rows:
        if len(kept[r["y"]]) < per_class[r["y"]]:
            kept[r["y"]].append((r["text"], r["y"]))
    total = sum(counts.values())
    return kept[0] + kept[1], counts.get(1, 0) / total if total else 0.0
