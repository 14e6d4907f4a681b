"""Regular-expression spans as DataFrame expressions, in code points, end exclusive.

A pattern's matches and the pieces between them come from the same leftmost
scan, so the running sum of their lengths gives every position.  Running values
are taken in blocks, and a text is cut into pieces of equal length before parts
of it are read, so no step copies what came before it for each match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,kind:string,value:string>"
NO_SPANS = f"cast(array() as array<{SPAN}>)"
#: Code points of one piece of a text that is cut up.
PIECE = 512


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that is no column of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The values joined from 0 on, before each (``out``) and in all (``all``)."""
    start = F.struct(F.lit(0).alias("all"), F.expr("cast(array() as array<int>)").alias("out"))
    return F.aggregate(values, start, lambda s, x: F.struct(join(s["all"], x).alias("all"), F.concat(s["out"], F.array(s["all"])).alias("out")))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What ``join``, which must be associative with 0 as its start, makes of the integers before each of ``values``.

    n values go in blocks of about the root of n, so that the arrays that grow stay short.
    """

    def blocks(v: Column, width: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), width), lambda at: _scan(F.slice(v, at + 1, width), join))
        heads = lambda p: _scan(F.transform(p, lambda x: x["all"]), join)["out"]
        return _let(parts, lambda p: F.flatten(F.zip_with(p, heads(p), lambda part, head: F.transform(part["out"], lambda x: join(head, x)))))

    return _let(values, lambda v: _let(F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1)), lambda width: blocks(v, width)))


def regex_spans(text: Column, pattern: str, kind: str, valid: Callable[[Column], Column] | None = None) -> Column:
    """Array of the pattern's leftmost non-overlapping matches whose text passes ``valid``; a failing match is dropped without a retry.

    ``pattern`` must not match the empty string.
    """

    def spans(s: Column) -> Column:
        # the piece after the last match has no value beside it
        gaps = F.zip_with(s["found"], F.slice(s["between"], 1, F.size(s["found"])), lambda v, g: F.struct(F.char_length(g).alias("gap"), F.char_length(v).alias("long"), v.alias("value")))
        return _let(gaps, placed)

    def placed(gaps: Column) -> Column:
        before = running(F.transform(gaps, lambda g: g["gap"] + g["long"]), lambda a, b: a + b)
        made = F.zip_with(gaps, before, lambda g, at: F.struct((at + g["gap"]).alias("start"), (at + g["gap"] + g["long"]).alias("end"), F.lit(kind).alias("kind"), g["value"].alias("value")))
        return made if valid is None else F.filter(made, lambda x: valid(x["value"]))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    return _let(both, spans)


def guarded(condition: Column, spans: Column) -> Column:
    """``spans`` where the cheap condition holds, else none."""
    return F.when(condition, spans).otherwise(F.expr(NO_SPANS))


def in_order(spans: Column, kinds: list[str]) -> Column:
    """Spans by start, then by the kind's place in ``kinds``, then by end."""
    place = F.create_map(*(x for k, name in enumerate(kinds) for x in (F.lit(name), F.lit(k))))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("k"), s["end"].alias("end"), s.alias("span")))
    return F.transform(F.array_sort(keyed), lambda x: x["span"])


def joined(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pieces(text: Column) -> Column:
    """The text cut into pieces of ``PIECE`` code points, for ``part``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def part(cut: Column, low: Column, high: Column) -> Column:
    """Code points [low, high) of a text given by its ``pieces``; places after its end hold nothing.

    Reading from a whole text walks there from its start, from pieces it takes
    the length of a piece and of what is read.
    """
    first, last = F.floor(low / PIECE).cast("int"), F.floor(high / PIECE).cast("int")
    piece = lambda k: F.coalesce(F.get(cut, k), F.lit(""))
    one = F.substring(piece(first), low % PIECE + 1, high - low)
    whole = F.array_join(F.slice(cut, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    return F.when(first == last, one).otherwise(F.concat(F.substring(piece(first), low % PIECE + 1, F.lit(PIECE)), whole, F.substring(piece(last), F.lit(1), high % PIECE)))


def masked(cut: Column, spans: Column) -> Column:
    """The text of ``pieces`` with each run of overlapping spans replaced by the first one's kind in brackets; ``spans`` in order."""
    reach = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    told = F.zip_with(spans, reach, lambda s, at: F.when(s["start"] >= at, F.concat(part(cut, at, s["start"]), F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit("")))
    end = F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.concat(F.array_join(told, ""), part(cut, end, F.size(cut) * PIECE))
