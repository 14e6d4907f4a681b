"""Segments as records of named fields and back, and labels by a list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import geometry as G
from strandline.session import numbered

#: Fields of a record that hold a segment's ends, in the order of ``Ends``.
TIPS = [f"p{i}_{a}" for i in (1, 2) for a in "xyz"]


def segments_to_records(segments: DataFrame, by: str) -> DataFrame:
    """``(pipe_number, individual_0, individual_1, fitness, p1_x .. p2_z)``, numbered from 1 in order of ``by``; the fitness is the length in space, the individuals are -1."""
    s = G.ends()
    ends = [c.alias(n) for c, n in zip(s, TIPS, strict=True)]
    return numbered(segments, by).select((F.col("n") + 1).alias("pipe_number"), F.lit(-1).alias("individual_0"), F.lit(-1).alias("individual_1"), G.length(s).alias("fitness"), *ends)


def records_to_segments(records: DataFrame) -> DataFrame:
    """``(pipe_number, x0 .. z1)`` of such records."""
    return records.select("pipe_number", *(F.col(n).alias(c) for n, c in zip(TIPS, G.Ends._fields, strict=True)))


def mapped_label(label: Column, mapping: Sequence[int]) -> Column:
    """The entry of ``mapping`` at the label's place, from 0; a label outside it is an error, a null one stays null."""
    return F.when(label.isNotNull(), F.element_at(F.array(*map(F.lit, mapping)), (label + 1).cast("int")))
