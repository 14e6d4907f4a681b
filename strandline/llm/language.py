"""Language of web pages by Bayesian evidence fusion.

Four pieces of evidence meet in one posterior: the likelihood of the visible
text under hashed character n-grams, the language that the markup declares, the
suffix of the address, and a prior of the host that is smoothed by its domain's
and the whole table's.  The declaration's, suffix's and hosts' tables are
grouped sums of the text posteriors over all pages.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import checkpoint

BUCKETS = 1 << 15
#: Bounds of the training sample: rows of a language, characters of a row.
PER_LANGUAGE, MOST_CHARS = 400, 20_000
#: N-grams overlap, so their log likelihood counts by this share.
TEMPER = 0.1
#: Pages' worth of its parent's shares that smooth a domain's and a host's, and of even shares that smooth a table's cell.
PRIOR_PAGES, CELL = 4.0, 0.5
#: Sums of keys that are broadcast, 8 bytes each.
MOST_SUMS = 2_000_000
_NOT_TEXT = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<[^>]*>?")
#: Comments, scripts and styles, which are skipped, or the attributes of an html start tag; every character is read once.
_HTML = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<html\b([^>]*)")
_DECLARED = re.compile(r"""(?i)\blang\s*=\s*["']?([a-z]{2,3})\b""")


def visible_text(page: str | None) -> str:
    """What a reader sees: no tags, scripts, styles or comments; entities resolved."""
    return markup.unescape(_NOT_TEXT.sub(" ", page or ""))


def declared_language(page: str | None) -> str:
    """Primary subtag of the html element's language, wherever its tag stands, or an empty string."""
    tags = (_DECLARED.search(m[2]) for m in _HTML.finditer(page or "") if m[2])
    return next((found[1].lower() for found in tags if found), "")


# fixed values: labels under which countries' registries give out names
_SECOND = {"ac", "co", "com", "edu", "gov", "net", "org"}


def address(url: str | None) -> tuple[str, str, str]:
    """Host, its domain, and its last label; empty strings if there is none.

    The domain is the last two labels, or three where the last is a country's and
    the one before it a general one, so that hosts under ``co.uk`` are not one.
    """
    try:
        host = (urlsplit(url or "").hostname or "").strip(".")
    except ValueError:
        host = ""
    labels = host.split(".")
    own = 3 if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in _SECOND else 2
    return host, ".".join(labels[-own:]), labels[-1]


def gram_buckets(text: str) -> np.ndarray:
    """Buckets of the bigrams and trigrams of the lower-cased text, runs of other than letters as one space."""
    x = np.frombuffer((" " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    two = x[:-1] * np.uint64(0x1F1F1F1F1F) + x[1:]
    three = two[:-1] * np.uint64(0x9E3779B1) + x[2:]
    mix = lambda h: ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)).astype(np.int64)
    return np.concatenate([mix(two), mix(three) + BUCKETS // 2])


@dataclass
class Model:
    """Languages in order, and the log probabilities of the buckets under each (languages, BUCKETS)."""

    languages: list[str]
    table: np.ndarray

    def log_likelihoods(self, text: str) -> np.ndarray:
        """Tempered; zeros if the text has no letters."""
        grams = gram_buckets(text)
        return TEMPER * np.array([row[grams].sum(dtype=np.float64) for row in self.table]) if len(grams) > 3 else np.zeros(len(self.languages))


def fit(rows: list[tuple[str, str]]) -> Model:
    """From (language, text) rows."""
    languages = sorted({lang for lang, _ in rows})
    counts = np.zeros((len(languages), BUCKETS))
    for lang, text in rows:
        counts[languages.index(lang)] += np.bincount(gram_buckets(text), minlength=BUCKETS)
    counts += 0.1
    return Model(languages, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, most_chars: int = MOST_CHARS) -> Model:
    """Fit on at most ``per_language`` texts of every ``lang`` value, picked by a hash of doc_id.

    Longer texts than ``most_chars`` give their start, and only where a
    language has too few others.  Rows without a text, language or id are passed
    over, of several rows with one id the least text counts; without any row
    there is one language, ``und``.
    """
    known = docs.filter("lang is not null and doc_id is not null and text is not null")
    long, low = F.char_length("text") > most_chars, F.xxhash64("doc_id")
    counts = known.groupBy("lang").agg(*(F.approx_count_distinct(F.when(c, F.col("doc_id"))).alias(n) for n, c in (("n_short", ~long), ("n_long", long)))).collect()
    if not counts:
        return fit([("und", "")])
    # the least hashes of each language, several times as many as are needed: only those rows are ranked
    enough = lambda n: min(1.0, 4 * per_language / max(n, 1))
    shares = [(r["lang"], enough(r["n_short"]), 0.0 if r["n_short"] >= 2 * per_language else enough(r["n_long"])) for r in counts]
    table = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, short_share double, long_share double"))
    rows = known.select("doc_id", F.col("lang").cast("string").alias("lang"), long.alias("long"), low.alias("low")).join(table, "lang")
    rows = rows.filter(F.col("low") / 2.0**64 + 0.5 <= F.when(F.col("long"), F.col("long_share")).otherwise(F.col("short_share"))).select("doc_id", "lang", "long", "low").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("long", "low", "doc_id"))
    chosen = rows.withColumn("rank", rank).filter(F.col("rank") <= per_language).select("doc_id", "lang").distinct()
    texts = known.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    return fit([(r["lang"], r["text"]) for r in texts.select("lang", F.substring("text", 1, most_chars).alias("text")).collect()])


def page_evidence(pages: DataFrame, model: Model) -> DataFrame:
    """``(page_id, host, domain, suffix, declared, ll array<double>)`` of every page, whatever other columns there are; null pages and addresses give empty texts and zeros."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            host, domain, suffix = zip(*map(address, batch["url"]), strict=True) if len(batch) else ((), (), ())
            values = [sent.value.log_likelihoods(visible_text(h)) for h in batch["html"]]
            yield pd.DataFrame({"id": batch["id"], "host": host, "domain": domain, "suffix": suffix, "declared": [declared_language(h) for h in batch["html"]], "ll": values})

    rows = pages.select(pages["page_id"].cast("string").alias("id"), "url", "html")
    found = rows.mapInPandas(run, "id string, host string, domain string, suffix string, declared string, ll array<double>")
    return found.withColumn("id", F.col("id").cast(pages.schema["page_id"].dataType)).withColumnRenamed("id", "page_id")


def _normal(values: list[Column]) -> list[Column]:
    """Log values as shares."""
    top = F.greatest(*values) if len(values) > 1 else values[0]
    parts = [F.exp(v - top) for v in values]
    total = reduce(lambda a, b: a + b, parts)
    return [p / total for p in parts]


def _with_sums(rows: DataFrame, table: DataFrame, key: str, pages: int) -> DataFrame:
    """``rows`` with their key's sums.

    Few keys are broadcast.  Of many, those of over a thousandth of all pages,
    of which there are a thousand at most, are broadcast, and the rest is
    shuffled, so that no large host lands in one task.
    """
    if table.count() * (len(table.columns) - 1) <= MOST_SUMS:
        return rows.join(F.broadcast(table), key)
    table = checkpoint(table)
    size = f"{table.columns[-1]}"
    often = F.broadcast(table.filter(F.col(size) > pages / 1000))
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(table, key)
    return rows.join(often, key).unionByName(rest)


def page_languages(pages: DataFrame, model: Model) -> DataFrame:
    """``(page_id, lang, probability, text_lang, declared, host)`` of every page.

    A page's own share is taken out of its host's and domain's sums, so that it
    does not count twice.  Null or empty pages and addresses give no evidence of
    their kind: a page without an address has the whole table's prior, and other
    such pages do not tell of it.  Equal posteriors go to the first language by
    name; repeated rows come back as often and count as often; an empty table
    gives none; other columns are left aside.
    """
    n = range(len(model.languages))
    seen = checkpoint(page_evidence(pages, model))
    shares = seen.withColumns({f"p{k}": s for k, s in zip(n, _normal([F.col("ll")[k] for k in n]), strict=True)})
    sums = lambda prefix: [F.sum(f"p{k}").alias(f"{prefix}{k}") for k in n]
    whole = F.broadcast(shares.agg(*sums("all"), F.count("*").alias("all_n")))  # one row
    rows = shares.crossJoin(whole)
    total = seen.count()
    for key, prefix in (("declared", "d"), ("suffix", "s"), ("domain", "o"), ("host", "h")):
        rows = _with_sums(rows, shares.groupBy(key).agg(*sums(prefix), F.count("*").alias(f"{prefix}_n")), key, total)
    posterior = []
    for k in n:
        own, total = F.col(f"p{k}"), F.col(f"all{k}")
        base = (total + 1) / (F.col("all_n") + len(n))
        domain = (F.col(f"o{k}") - own + PRIOR_PAGES * base) / (F.col("o_n") - 1 + PRIOR_PAGES)
        host = (F.col(f"h{k}") - own + PRIOR_PAGES * domain) / (F.col("h_n") - 1 + PRIOR_PAGES)
        prior = F.when(F.col("host") == "", base).otherwise(host)
        value = F.col("ll")[k] + F.log(F.greatest(prior, F.lit(1e-9)))
        for prefix, key in (("d", "declared"), ("s", "suffix")):
            cell = (F.col(f"{prefix}{k}") - own + CELL * F.col(f"{prefix}_n") / F.col("all_n")) / (total - own + CELL)
            value = value + F.when(F.col(key) == "", 0.0).otherwise(F.log(F.greatest(cell, F.lit(1e-9))))
        posterior.append(value)
    rows = rows.withColumn("post", F.array(*_normal(posterior)))
    names = F.array(*map(F.lit, model.languages))
    first = lambda values: names[(F.array_position(values, F.array_max(values)) - 1).cast("int")]
    return rows.select("page_id", first(F.col("post")).alias("lang"), F.array_max("post").alias("probability"), first(F.col("ll")).alias("text_lang"), "declared", "host")
