"""Secret scanning behind a trigram inverted index.  DataFrame functions only.

Each rule's regular expression gives a Boolean query over trigrams.  One pass
over the texts writes the postings (trigram, text key) of the trigrams that
some rule asks for; grouping them by key intersects the posting lists, and only
the candidates are verified by the rule's pattern.  Rules without a mandatory
trigram scan every text.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.spans import fresh, guarded, in_order, joined, regex_spans
from strandline.llm.trigrams import Query, trigram_query, trigrams_of
from strandline.session import checkpoint

#: Candidate keys (a dozen bytes each) that are sent to the rows, and shares of the rows of a key where they go to it.
MOST_BROADCAST, SALTS = 400_000, 16


class Rule(NamedTuple):
    """``plain`` in Python's syntax gives the trigram query, ``pattern`` in Java's finds the matches."""

    kind: str
    pattern: str
    plain: str
    valid: object = None


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]++)"""
_ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?"""


def _long_value(value: Column) -> Column:
    return F.char_length(F.regexp_replace(value, _ASSIGN_HEAD, "")) >= 12


BASE_KINDS = ["assign", "access", "hex"]
#: Key formats that their issuers document publicly come after the three base rules.
RULES = [
    Rule("assign", _ASSIGN, r"(password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", _long_value),
    Rule("access", r"AKIA[A-Z0-9]++", r"AKIA[A-Z0-9]+", lambda v: F.char_length(v) >= 18),
    Rule("hex", r"[0-9a-f]{16,}+", r"[0-9a-f]{16,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", r"-----BEGIN ([A-Z]+ ){0,3}PRIVATE KEY-----"),
]
KINDS = [r.kind for r in RULES]


def _holds(query: Query, grams: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(grams, query)
    parts = [_holds(q, grams) for q in query[1]]
    return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), parts)


def postings(docs: DataFrame, text_col: str, rules: list[Rule]) -> DataFrame:
    """The inverted index: distinct (trigram, key) of the rules' trigrams; a key is the text's hash, so copies are posted once."""
    grams = sorted(set().union(*(trigrams_of(trigram_query(r.plain)) for r in rules)))
    low = docs.select(F.xxhash64(docs[text_col]).alias("key"), F.lower(docs[text_col]).alias("low"))
    held = F.filter(F.array(*map(F.lit, grams)).cast("array<string>"), lambda g: F.contains(F.col("low"), g))
    return low.select("key", F.explode(held).alias("trigram")).distinct()


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """(key, rules): the posting lists intersected as each rule's query says; ``rules`` has a bit for each rule's place."""
    lists = index.groupBy("key").agg(F.collect_set("trigram").alias("grams"))
    asked = [F.when(_holds(q, F.col("grams")), F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(rules) if (q := trigram_query(r.plain)) is not True]
    return lists.select("key", reduce(lambda a, b: a.bitwiseOR(b), asked, F.lit(0)).alias("rules")).filter("rules <> 0")


def _with_rules(docs: DataFrame, text_col: str, rules: list[Rule], name: str) -> DataFrame:
    """``docs`` with the bits of the rules that the index asks of each text, or null.

    Up to ``MOST_BROADCAST`` candidate keys are sent to the rows, and no text
    moves.  Beyond it the rows go to their keys, in ``SALTS`` shares by the task
    that read them, so that copies of one text do not share a task.
    """
    key, salt, share = (fresh(docs, f"{name}_{part}") for part in ("key", "salt", "share"))
    found = checkpoint(candidates(postings(docs, text_col, rules), rules)).select(F.col("key").alias(key), F.col("rules").alias(name))
    same = F.xxhash64(docs[text_col]) == found[key]
    if found.count() <= MOST_BROADCAST:
        return docs.join(F.broadcast(found), same, "left").drop(key)
    rows = docs.withColumn(salt, F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    found = found.withColumn(share, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = (F.xxhash64(rows[text_col]) == found[key]) & (rows[salt] == found[share])
    return rows.join(found, same, "left").drop(key, salt, share)


def find_secrets(docs: DataFrame, text_col: str = "text", into: str = "secrets", rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` with the array ``into`` of (start, end, kind, value), by start, then rule.

    Null and empty texts and an empty table have no spans; rows, repeated ones
    too, and columns of any name stay (one named like ``into`` is replaced).  Of
    matches of one rule the leftmost counts, spans of different rules may
    overlap.  Copies of a text share one key of the index, and a shared key never
    hides or adds a span: every candidate is verified on its own text.
    """
    name = fresh(docs, "_rules")
    rows = _with_rules(docs, text_col, rules, name)
    text = F.coalesce(rows[text_col].cast("string"), F.lit(""))
    parts = []
    for k, rule in enumerate(rules):
        spans = regex_spans(text, rule.pattern, rule.kind, rule.valid)
        parts.append(spans if trigram_query(rule.plain) is True else guarded(rows[name].bitwiseAND(F.lit(1 << k)) != 0, spans))
    rows = rows.withColumn(name, F.concat(*parts))
    return rows.withColumn(into, F.when(F.size(rows[name]) > 0, in_order(rows[name], [r.kind for r in rules])).otherwise(rows[name])).drop(name)


def secrets_digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of each document, a row for each row; null and empty texts count as without spans."""
    spans = F.col("secrets")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_secrets(docs.select("doc_id", "text")).select("doc_id", *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))
