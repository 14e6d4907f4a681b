"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from strandline.llm import pii

#: A 512-token budget with 96 tokens and 4 turns of history: the defaults of ``format_chat``.
CHAT = r"""
WITH input AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), counted AS (
  SELECT *, len(regexp_extract_all(text, '[^ \n\t\r]{1,4}')) + 3 AS tokens,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    14 + length(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), ':', '\c'))
      + length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h')) AS chars
  FROM input
), costed AS (
  SELECT *, pos = 1 AND role = 'system' AS is_system, CASE WHEN pos = 1 AND role = 'system' THEN 0 ELSE tokens END AS cost FROM counted
), opened AS (
  SELECT *, max(CASE WHEN is_system THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS system_tokens,
    max(CASE WHEN is_system THEN chars END) OVER (PARTITION BY conv_id) AS system_chars,
    sum(cost) OVER (PARTITION BY conv_id ORDER BY pos) AS prefix
  FROM costed
), allowing AS (
  SELECT *, greatest(least(96, 512 - 64 - system_tokens), 0) AS allowed FROM opened
), halves AS (
  SELECT *, greatest(512 - allowed - system_tokens, 64) / 2e0 AS half FROM allowing
), bucketed AS (
  SELECT *, cost > half AS big, greatest(floor((prefix - 1) / half), 0) AS bucket FROM halves
), marked AS (
  SELECT *, (pos = 1 OR bucket <> lag(bucket) OVER c OR big OR lag(big) OVER c) AND NOT coalesce(pos = 2 AND lag(is_system) OVER c, false) AS opens
  FROM bucketed WINDOW c AS (PARTITION BY conv_id ORDER BY pos)
), used AS (
  SELECT *,
    CASE WHEN opens AND pos > 1 THEN coalesce(system_chars, 0) ELSE 0 END
    + CASE WHEN is_system THEN 0 ELSE chars * (
      CASE WHEN lead(opens, 1) OVER c AND lead(prefix - cost, 1) OVER c - prefix + cost <= allowed THEN 1 ELSE 0 END
      + CASE WHEN lead(opens, 2) OVER c AND lead(prefix - cost, 2) OVER c - prefix + cost <= allowed THEN 1 ELSE 0 END
      + CASE WHEN lead(opens, 3) OVER c AND lead(prefix - cost, 3) OVER c - prefix + cost <= allowed THEN 1 ELSE 0 END
      + CASE WHEN lead(opens, 4) OVER c AND lead(prefix - cost, 4) OVER c - prefix + cost <= allowed THEN 1 ELSE 0 END) END AS repeated
  FROM marked WINDOW c AS (PARTITION BY conv_id ORDER BY pos)
), whole AS (
  SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS said,
    coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS learned,
    CAST(sum(chars + repeated) AS BIGINT) AS formatted_chars
  FROM used GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars
FROM whole
"""

#: Brute force over all pairs of the floored vectors; of several rows with a query's id the least asks, and each is an answer of its own.
TOP_K = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), asked AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x, r) = 1 AS asks FROM v
), parts AS (
  SELECT r, vec_id, asks, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM asked
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 AND q.asks GROUP BY q.vec_id, c.vec_id, c.r
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""


def _either(word: str) -> str:
    """ASCII letters of a word in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The secret rules' patterns without possessive marks, and what their matches must hold.
_KEYWORDS = "(?:" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + ")[\"']? *[:=] *[\"']?"
_SECRETS = [
    ("assign", _KEYWORDS + "[A-Za-z0-9+/_.=-]+", "length(regexp_replace(value, '^" + _KEYWORDS.replace("'", "''") + "', '')) >= 12"),
    ("access", "AKIA[A-Z0-9]+", "length(value) >= 18"),
    ("hex", "[0-9a-f]+", "length(value) >= 16"),
    ("github", "gh[pousr]_[A-Za-z0-9]{36}", "true"),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", "true"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
    ("private_key", "-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", "true"),
]


def _found(place: int, kind: str, pattern: str, holds: str) -> str:
    """Matches of one rule with their places: the lengths of all pieces and matches before them."""
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT r, {place} AS place, '{kind}' AS kind, value, low, low + length(value) AS high FROM (
    SELECT r, unnest(v) AS value, unnest(list_transform(range(1, len(v) + 1), lambda i: CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: length(x))), 0) AS BIGINT))) AS low
    FROM (SELECT r, regexp_extract_all(text, {p}) AS v, regexp_split_to_array(text, {p}) AS g FROM d)) WHERE {holds}"""


def _digest(kinds: list[str], found: list[str]) -> str:
    base = ", ".join(f"'{k}'" for k in kinds)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in kinds)
    text = "string_agg(kind || ':' || low || ':' || high, ',' ORDER BY low, place, high)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(found)})
SELECT any_value(doc_id) AS doc_id, {counts}, sha256(coalesce({text} FILTER (kind IN ({base})), '')) AS base_sha256, coalesce({text} FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN found USING (r) GROUP BY r
"""


def _luhn(digits: str) -> str:
    """The digits, doubled at every second place from the right, sum to a multiple of ten."""
    d = f"CAST(substr({digits}, i, 1) AS INT)"
    return f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 0 THEN {d} ELSE 2 * {d} - CASE WHEN {d} > 4 THEN 9 ELSE 0 END END)) % 10 = 0"


_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_BARE = "replace(value, ' ', '')"
_MOD97 = f"list_reduce(list_prepend(0, list_transform(string_split(substr({_BARE}, 5) || substr({_BARE}, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INT) ELSE ascii(c) - 55 END)), lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97) = 1"
#: Kind, plain pattern, what a match must hold, score, context words.
_PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(value, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(ltrim(x, '0') AS INT), 0) > 255)) = 0"),
    ("card", "[0-9](?:[ -]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_luhn(_DIGITS)}"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", f"length({_BARE}) BETWEEN 15 AND 34 AND {_MOD97}"),
    ("ssn", "[0-9]+(?:-[0-9]+)*", f"regexp_matches(value, '{pii.SSN}')"),
    ("birth", "[0-9]+(?:[./-][0-9]+)*", f"regexp_matches(value, '{pii.BIRTH}')"),
]


def _pii() -> str:
    near = f"lower(substr(text, greatest(low - {pii.NEAR}, 0) + 1, low - greatest(low - {pii.NEAR}, 0)) || ' ' || substr(text, high + 1, {pii.NEAR}))"
    edge = r"[^\p{L}\p{N}_]"
    scores = " ".join(f"WHEN '{k}' THEN {pii.PRIOR[k]}e0 + CASE WHEN regexp_matches({near}, '(^|{edge})(?:{pii.CONTEXT[k]})($|{edge})') THEN {pii.RAISE}e0 ELSE 0e0 END" for k in pii.KINDS)
    base = ", ".join(f"'{k}'" for k in pii.BASE_KINDS)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE_KINDS)
    text = "string_agg(kind || ':' || low || ':' || high, ',' ORDER BY low, place, high)"
    matches = " UNION ALL ".join(_found(k, *rule) for k, rule in enumerate(_PII))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
matches AS ({matches}),
scored AS (SELECT r, place, kind, low, high, round(CASE kind {scores} END, 6) AS score FROM matches JOIN d USING (r)),
found AS (SELECT * FROM scored WHERE score >= {pii.KEEP})
SELECT any_value(doc_id) AS doc_id, {counts}, sha256(coalesce({text} FILTER (kind IN ({base})), '')) AS base_sha256, coalesce({text} FILTER (kind IS NOT NULL), '') AS spans,
  coalesce(string_agg(printf('%.1f', score), ',' ORDER BY low, place, high) FILTER (kind IS NOT NULL), '') AS scores
FROM d LEFT JOIN found USING (r) GROUP BY r
"""


PII = _pii()
SECRETS = _digest(["assign", "access", "hex"], [_found(k, *rule) for k, rule in enumerate(_SECRETS)])
