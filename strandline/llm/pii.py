"""Personal data: patterns propose spans, checksums confirm them, context words move the score.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.spans import fresh, guarded, in_order, joined, masked, part, pieces, regex_spans

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "iban", "ssn", "birth"]

# Possessive repeats and starts at the edge of a run (or where the last match
# ended) give the plain patterns' matches without their backtracking.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])"
#: Runs of digits and marks, which count if the whole run has a form.
DASHED, DATED = r"[0-9]++(?:-[0-9]++)*+", r"[0-9]++(?:[./-][0-9]++)*+"
SSN = r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"
BIRTH = r"^(?:(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[./](?:0?[1-9]|1[0-2])[./](?:19|20)[0-9]{2})$"

#: Whole words near a span that raise its score, by kind.
CONTEXT = {
    "email": "e-?mails?|contact|write|kontakt|correo|courriel",
    "ip": "ip|server|host|address|adresse",
    "card": "cards?|visa|credit|karte|carte|tarjeta",
    "phone": "phone|tel|telephone|call|mobile|fax|telefon|llame",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social|security|tax",
    "birth": "birth|birthday|born|dob|geboren|geburtsdatum|naissance|nacimiento",
}
#: Score of a confirmed span before its context is read; a span is kept from ``KEEP`` on, and the base kinds begin above it.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "birth": 0.3}
RAISE, KEEP, NEAR = 0.2, 0.5, 40


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _byte_parts(value: Column) -> Column:
    bare = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(bare, lambda p: (F.length(p) <= 3) & (F.when(p == "", 0).otherwise(F.substring(p, 1, 3).cast("int")) <= 255))


def _card(value: Column) -> Column:
    return F.length(_digits(value)).between(12, 19) & F.call_function("luhn_check", _digits(value))


def _mod97(value: Column) -> Column:
    bare = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    step = lambda rest, c: F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)
    return F.length(bare).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c)).cast("int")) == 1)


def _scored(cut: Column, spans: Column) -> Column:
    def score(s: Column) -> Column:
        low = F.greatest(s["start"] - NEAR, F.lit(0))
        near = F.lower(F.concat(part(cut, low, s["start"]), F.lit(" "), part(cut, s["end"], s["end"] + NEAR)))
        prior, hit = F.lit(0.0), F.lit(False)
        for kind in KINDS:
            prior = F.when(s["kind"] == kind, F.lit(PRIOR[kind])).otherwise(prior)
            hit = F.when(s["kind"] == kind, near.rlike(rf"(?<![\p{{L}}\p{{N}}_])(?:{CONTEXT[kind]})(?![\p{{L}}\p{{N}}_])")).otherwise(hit)
        return s.withField("score", F.round(prior + F.when(hit, F.lit(RAISE)).otherwise(F.lit(0.0)), 6))

    return F.filter(F.transform(spans, score), lambda s: s["score"] >= KEEP)


def _found(text: Column) -> Column:
    """All confirmed spans of a text, unordered; each pattern runs only on texts that hold a character it needs."""
    digit = text.rlike("[0-9]")
    holds = lambda c: F.contains(text, F.lit(c))
    phone = lambda v: F.length(_digits(v)).between(9, 15)
    parts = [
        guarded(holds("@"), regex_spans(text, EMAIL, "email")),
        guarded(digit & holds("."), regex_spans(text, IP, "ip", _byte_parts)),
        guarded(digit, regex_spans(text, CARD, "card", _card)),
        guarded(digit & holds("+"), regex_spans(text, PHONE, "phone", phone)),
        guarded(digit & text.rlike("[A-Z]{2}[0-9]{2}"), regex_spans(text, IBAN, "iban", _mod97)),
        guarded(text.rlike("[0-9]-[0-9]{2}-[0-9]"), regex_spans(text, DASHED, "ssn", lambda v: v.rlike(SSN))),
        guarded(text.rlike("[0-9][./-][0-9]"), regex_spans(text, DATED, "birth", lambda v: v.rlike(BIRTH))),
    ]
    return F.concat(*parts)


def _with_spans(docs: DataFrame, text_col: str, into: str) -> DataFrame:
    """``docs`` with ``into``: a struct of the spans in order and, where there are any, the text's pieces."""
    found = docs.withColumn(into, _found(F.coalesce(docs[text_col].cast("string"), F.lit(""))))
    own = F.col(f"`{into}`")
    some = F.size(own) > 0
    found = found.withColumn(into, F.struct(own.alias("spans"), F.when(some, pieces(found[text_col].cast("string"))).alias("cut")))
    scored = in_order(_scored(own["cut"], own["spans"]), KINDS)
    return found.withColumn(into, F.struct(F.when(F.size(own["spans"]) > 0, scored).otherwise(_scored(own["cut"], F.slice(own["spans"], 1, 0))).alias("spans"), own["cut"].alias("cut")))


def find_personal_data(docs: DataFrame, text_col: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with the array ``into`` of (start, end, kind, value, score), by start, then kind.

    Null and empty texts and an empty table have no spans; rows, repeated ones
    too, and columns of any name stay (one named like ``into`` is replaced).  Of
    matches of one kind the leftmost counts, spans of different kinds may
    overlap.  A span's score is its kind's prior, more if a context word of the
    kind stands within ``NEAR`` code points; the kinds that begin under ``KEEP``
    (``ssn``, ``birth``) count only with such a word, the others always.  The
    work grows with the text's length, with the number of its spans to the
    power of 1.5 at most.
    """
    name = fresh(docs.drop(into), "_spans")
    rows = _with_spans(docs.drop(into), text_col, name) if text_col != into else _with_spans(docs, text_col, name)
    return rows.withColumn(into, rows[name]["spans"]).drop(name)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets, overlapping ones by the first one's.

    A null text stays null, an empty one empty; rows, repeated ones too, and
    columns of any name stay.
    """
    name = fresh(docs, "_spans")
    found = _with_spans(docs, text_col, name)
    own = found[name]
    text = F.when(F.size(own["spans"]) > 0, masked(own["cut"], own["spans"])).otherwise(found[text_col])
    return found.withColumn(text_col, text).select(*(f"`{c}`" for c in docs.columns))


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts, digests and scores of the spans of each document, a row for each row; null and empty texts count as without spans."""
    spans = F.col("pii")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    scores = F.array_join(F.transform(spans, lambda s: F.format_number(s["score"], 1)), ",").alias("scores")
    return find_personal_data(docs.select("doc_id", "text")).select("doc_id", *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"), scores)
