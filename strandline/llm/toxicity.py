"""Toxicity of whole texts: a bidirectional gated recurrent network with attention pooling over windows of words.

A word enters as its hashed embedding beside the mean of its hashed character
n-grams.  Windows of ``LENGTH`` words overlap by half, every window is scored,
and a text's score comes from its most toxic window.  Trained in numpy on the
driver from a bounded sample; scoring streams over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.sampling import labelled_sample, remainder

LENGTH, STRIDE = 32, 16
WORDS, GRAMS, DIM, HIDDEN, ATTEND = 8192, 16384, 12, 12, 8
GATES = 3 * HIDDEN
#: Bounds of the training sample: rows of label 0 and of label 1, characters of a row, windows of a row.
PER_CLASS, MOST_CHARS, ROW_WINDOWS = (4500, 1500), 20_000, 8
EPOCHS, BATCH, RATE = 4, 256, 4e-3
THRESHOLD = 0.3
#: Standard deviations from which a bucket's evidence starts its embedding.
SURE = 3.0
#: Largest slope of the line that makes a value a probability.
STEEPEST = 3.0
#: Words whose inputs a worker keeps before it starts afresh, and words of text that are scored at once.
CACHE, AT_ONCE = 150_000, 150_000
#: New words whose n-grams are worked out at once.
WORDS_AT_ONCE = 20_000

# ASCII letters in lower case, digits as 0, other ASCII marks as space; bytes of other letters stay
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text; a text without any gives one empty word."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split() or [b""]


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, n-gram buckets of all words, and where each word's n-grams begin."""
    blob = b"".join(b"\x02" + w + b"\x03" for w in words)
    sizes = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    begin = np.cumsum(sizes) - sizes
    b = np.frombuffer(blob + b"\0\0\0", dtype=np.uint8).astype(np.uint64)
    n = len(blob)
    left = np.repeat(begin + sizes, sizes) - np.arange(n)  # bytes of the word from here on
    two = b[:-1] * np.uint64(257) + b[1:]
    three = two[:n] * np.uint64(263) + np.where(left >= 3, b[2 : n + 2], np.uint64(0))  # the empty word is shorter
    four = three * np.uint64(269) + b[3 : n + 3]
    mix = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    grams = np.stack([mix(three) % np.uint64(GRAMS // 2), mix(four) % np.uint64(GRAMS // 2) + np.uint64(GRAMS // 2)], axis=1).astype(np.int64)
    ok = np.stack([(left >= 3) | (left == np.repeat(sizes, sizes)), left >= 4], axis=1)
    per = np.add.reduceat(ok.sum(1), begin)
    powers = np.uint64(1099511628211)
    hashes = np.zeros(len(words), dtype=np.uint64)
    place = np.arange(n) - np.repeat(begin, sizes)
    weights = np.cumprod(np.full(int(sizes.max()), powers, dtype=np.uint64))[place]
    hashes = np.add.reduceat(b[:n] * weights, begin)
    return (mix(hashes) % np.uint64(WORDS)).astype(np.int64), grams[ok], np.cumsum(per) - per


def windows_of(count: int) -> list[int]:
    """Where the windows of a text of ``count`` words start; the last one ends with the text."""
    if count <= LENGTH:
        return [0]
    starts = list(range(0, count - LENGTH, STRIDE))
    return [*starts, count - LENGTH]


@dataclass
class Model:
    """Weights, and the line that turns a text's largest window value into a probability."""

    p: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    cache: dict[bytes, int] = field(default_factory=dict, repr=False)
    rows: list[np.ndarray] = field(default_factory=list, repr=False)

    def embed(self, words: list[bytes]) -> np.ndarray:
        """Inputs of each word, and a 1 for the bias."""
        bucket, grams, begin = word_features(words)
        mean = np.add.reduceat(self.p["chars"][grams], begin, axis=0) / np.diff([*begin, len(grams)])[:, None]
        return np.concatenate([self.p["words"][bucket], mean, np.ones((len(words), 1))], axis=1).astype(np.float32)

    def window_values(self, x: np.ndarray) -> np.ndarray:
        """Values of windows from their words' inputs (steps, windows, 2 * DIM + 1).

        States are kept with windows along the rows' end, so that every gate is
        one stretch of memory.
        """
        steps, count, _ = x.shape
        out = np.empty((steps, 2 * HIDDEN, count), dtype=np.float32)
        half = np.where(np.arange(GATES) < 2 * HIDDEN, 0.5, 1.0).astype(np.float32)[:, None]  # a sigmoid by tanh
        for low, side, order in ((0, "f", range(steps)), (HIDDEN, "b", range(steps - 1, -1, -1))):
            into = half * np.concatenate([self.p[f"in_{side}"], self.p[f"bias_{side}"][None]]).T
            again = half * self.p[f"rec_{side}"].T
            h = np.zeros((HIDDEN, count), dtype=np.float32)
            for t in order:
                a, r = into @ x[t].T, again @ h
                rz, n = r[: 2 * HIDDEN], r[2 * HIDDEN :]
                rz += a[: 2 * HIDDEN]
                np.tanh(rz, out=rz)
                rz += np.float32(1)
                rz *= np.float32(0.5)
                n *= rz[:HIDDEN]
                n += a[2 * HIDDEN :]
                np.tanh(n, out=n)
                h = h - n
                h *= rz[HIDDEN:]
                h += n
                out[t, low : low + HIDDEN] = h
        weight = np.einsum("a,tab->tb", self.p["att_v"], np.tanh(np.matmul(self.p["att"].T, out)), optimize=True)
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        return self.p["out"] @ (out * weight[:, None, :]).sum(0) + self.p["out_b"][0]

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Rows of the kept inputs, after adding the words that are new."""
        new = set(words).difference(self.cache)
        if new:
            if len(self.cache) + len(new) > CACHE:
                self.cache.clear()
                self.rows.clear()
                new = set(words)
            listed = sorted(new)
            self.cache.update(zip(listed, range(len(self.cache), len(self.cache) + len(listed)), strict=True))
            self.rows[:] = [np.concatenate([*self.rows, *(self.embed(listed[low : low + WORDS_AT_ONCE]) for low in range(0, len(listed), WORDS_AT_ONCE))])]
        return np.fromiter(map(self.cache.__getitem__, words), dtype=np.int64, count=len(words))

    def text_values(self, texts: list[list[bytes]]) -> np.ndarray:
        """Largest window value of each text."""
        ids = self.ids([w for t in texts for w in t])
        first = np.cumsum([0, *map(len, texts)])
        starts, owner, size = [], [], []
        for k, t in enumerate(texts):
            own = windows_of(len(t))
            starts += [first[k] + s for s in own]
            owner += [k] * len(own)
            size += [min(len(t), LENGTH)] * len(own)
        starts, owner, size = np.array(starts), np.array(owner), np.array(size)
        best = np.full(len(texts), -np.inf, dtype=np.float64)
        for steps in np.unique(size):
            of = np.nonzero(size == steps)[0]
            for low in range(0, len(of), 1024):
                part = of[low : low + 1024]
                x = self.rows[0][ids[starts[part][None, :] + np.arange(steps)[:, None]]]
                np.maximum.at(best, owner[part], self.window_values(x))
        return best

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability that each text is toxic; texts are gathered up to a bounded number of words, and a longer one is scored in pieces that overlap like windows."""
        out, held, held_of, total = np.full(len(texts), -np.inf), [], [], 0

        def flush() -> None:
            if held:
                np.maximum.at(out, held_of, self.text_values(held))
                held.clear()
                held_of.clear()

        for k, text in enumerate(texts):
            words = words_of(text)
            for low in range(0, max(1, len(words) - LENGTH + STRIDE), AT_ONCE):
                part = words[low : low + AT_ONCE + LENGTH - STRIDE]
                held.append(part)
                held_of.append(k)
                total += len(part)
                if total >= AT_ONCE:
                    flush()
                    total = 0
        flush()
        return 1 / (1 + np.exp(-np.clip(self.slope * out + self.shift, -50, 50)))


def _pooled(p: dict[str, np.ndarray], h: np.ndarray):
    """Attention over steps: values and what the backward pass needs."""
    u = np.tanh(h @ p["att"])
    e = u @ p["att_v"]
    w = np.exp(e - e.max(0))
    w /= w.sum(0)
    pooled = np.einsum("tb,tbd->bd", w, h, optimize=True)
    return pooled @ p["out"] + p["out_b"][0], (u, w, pooled)


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    normal = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    p = {"words": normal(WORDS, DIM, by=0.1), "chars": normal(GRAMS, DIM, by=0.3)}
    for side in "fb":
        p |= {f"in_{side}": normal(2 * DIM, GATES, by=0.3), f"bias_{side}": np.zeros(GATES, np.float32), f"rec_{side}": normal(HIDDEN, GATES, by=0.25)}
    return p | {"att": normal(2 * HIDDEN, ATTEND, by=0.3), "att_v": normal(ATTEND, by=0.3), "out": normal(2 * HIDDEN, by=0.3), "out_b": np.zeros(1, np.float32)}


def _run(p: dict[str, np.ndarray], x: np.ndarray, side: str):
    """One direction over (steps, batch, inputs), with what the backward pass needs."""
    steps, count, _ = x.shape
    gates = x @ p[f"in_{side}"] + p[f"bias_{side}"]
    order = range(steps) if side == "f" else range(steps - 1, -1, -1)
    h, kept, out = np.zeros((count, HIDDEN), np.float32), [], np.empty((steps, count, HIDDEN), np.float32)
    for t in order:
        r = h @ p[f"rec_{side}"]
        rz = 1 / (1 + np.exp(-(gates[t, :, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])))
        n = np.tanh(gates[t, :, 2 * HIDDEN :] + rz[:, :HIDDEN] * r[:, 2 * HIDDEN :])
        kept.append((t, h, rz, n, r[:, 2 * HIDDEN :]))
        h = n + rz[:, HIDDEN:] * (h - n)
        out[t] = h
    return out, kept


def _back(p: dict[str, np.ndarray], x: np.ndarray, dout: np.ndarray, kept: list, side: str, g: dict[str, np.ndarray]) -> np.ndarray:
    dgates = np.empty((*x.shape[:2], GATES), np.float32)
    drec = np.zeros_like(p[f"rec_{side}"])
    dh = np.zeros_like(dout[0])
    for t, before, rz, n, rn in reversed(kept):
        dh = dh + dout[t]
        r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
        dn = dh * (1 - z) * (1 - n * n)
        d = np.concatenate([dn * rn * r * (1 - r), dh * (before - n) * z * (1 - z), dn], axis=1)
        dgates[t] = d
        d = np.concatenate([d[:, : 2 * HIDDEN], dn * r], axis=1)
        drec += before.T @ d
        dh = dh * z + d @ p[f"rec_{side}"].T
    flat = dgates.reshape(-1, GATES)
    g[f"in_{side}"], g[f"bias_{side}"], g[f"rec_{side}"] = x.reshape(-1, x.shape[2]).T @ flat, flat.sum(0), drec
    return dgates @ p[f"in_{side}"].T


def _step(p: dict[str, np.ndarray], words: tuple, ids: np.ndarray, y: np.ndarray, drop: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Values and gradients of the mean logistic loss; ids: (steps, batch) into the vocabulary ``words``."""
    bucket, grams, begin = words
    own, where = np.unique(ids, return_inverse=True)
    where = where.reshape(ids.shape)
    sizes = np.diff([*begin, len(grams)])[own]
    at = np.repeat(begin[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    heads = np.cumsum(sizes) - sizes
    mean = np.add.reduceat(p["chars"][grams[at]], heads, axis=0) / sizes[:, None]
    table = np.concatenate([p["words"][bucket[own]] * drop[own][:, None], mean], axis=1).astype(np.float32)
    x = table[where]
    hf, kf = _run(p, x, "f")
    hb, kb = _run(p, x, "b")
    h = np.concatenate([hf, hb], axis=2)
    value, (u, w, pooled) = _pooled(p, h)
    dv = ((1 / (1 + np.exp(-value)) - y) / len(y)).astype(np.float32)
    g = {"out": pooled.T @ dv, "out_b": np.array([dv.sum()], np.float32)}
    dpool = dv[:, None] * p["out"]
    dw = np.einsum("tbd,bd->tb", h, dpool, optimize=True)
    de = w * (dw - (w * dw).sum(0))
    du = de[:, :, None] * p["att_v"] * (1 - u * u)
    g["att_v"] = np.einsum("tb,tba->a", de, u, optimize=True)
    g["att"] = np.einsum("tbd,tba->da", h, du, optimize=True)
    dh = w[:, :, None] * dpool + du @ p["att"].T
    dx = _back(p, x, dh[:, :, :HIDDEN], kf, "f", g) + _back(p, x, dh[:, :, HIDDEN:], kb, "b", g)
    dtable = np.zeros_like(table)
    np.add.at(dtable, where.ravel(), dx.reshape(-1, x.shape[2]))
    g["words"] = np.zeros_like(p["words"])
    np.add.at(g["words"], bucket[own], dtable[:, :DIM] * drop[own][:, None])
    g["chars"] = np.zeros_like(p["chars"])
    np.add.at(g["chars"], grams[at], np.repeat(dtable[:, DIM:] / sizes[:, None], sizes, axis=0).astype(np.float32))
    return value, g


def _line(values: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on one value, by Newton steps with a little shrinkage."""
    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * values + b, -30, 30)))
        r, s = weight * (q - y), weight * q * (1 - q)
        grad = np.array([(r * values).sum() + 0.1 * (a - 1), r.sum() + 0.01 * b])
        hess = np.array([[(s * values * values).sum() + 0.1, (s * values).sum()], [(s * values).sum(), s.sum() + 0.01]])
        move = np.linalg.solve(hess, grad)
        a, b = a - move[0], b - move[1]
        if abs(move).max() < 1e-6:
            break
    if not 0.05 <= a <= STEEPEST:  # parted without overlap: the slope would grow without end
        a = min(max(a, 0.05), STEEPEST)
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(a * values + b, -30, 30)))
            b -= float(((weight * (q - y)).sum() + 0.01 * b) / ((weight * q * (1 - q)).sum() + 0.01))
    return float(a), float(b)


def _vocabulary(words: list[bytes], at_once: int = WORDS_AT_ONCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``word_features`` of many words, worked out in parts to spare memory."""
    parts = [word_features(words[low : low + at_once]) for low in range(0, len(words), at_once)]
    shifts = np.cumsum([0, *(len(g) for _, g, _ in parts)])
    grams = np.concatenate([g.astype(np.int32) for _, g, _ in parts])
    return np.concatenate([b for b, _, _ in parts]), grams, np.concatenate([f + s for (_, _, f), s in zip(parts, shifts, strict=False)])


def _evidence(p: dict[str, np.ndarray], vocabulary: tuple, codes: list[np.ndarray], y: np.ndarray) -> None:
    """Start the first dimension of each embedding from how far its bucket's share of toxic texts is from that of the others, in standard deviations; doubtful ones start at 0."""
    bucket, grams, begin = vocabulary
    ends = [*begin[1:], len(grams)]
    toxic, total = max(y.sum(), 1.0), float(len(y))
    for name, size in (("words", WORDS), ("chars", GRAMS)):
        seen = np.zeros((2, size))
        for code, label in zip(codes, y, strict=True):
            own = np.unique(code)
            held = bucket[own] if name == "words" else np.concatenate([grams[begin[k] : ends[k]] for k in own])
            seen[int(label), np.unique(held)] += 1
        share = seen.sum(0) / total
        spread = np.sqrt(share * (1 - share) * (1 / toxic + 1 / max(total - toxic, 1.0))) + 1e-9
        z = (seen[1] / toxic - seen[0] / max(total - toxic, 1.0)) / spread
        p[name][:, 0] = np.where(np.abs(z) >= SURE, np.clip(z, -10, 10) * 0.3, 0.0)


def _cut(values: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The value that parts the classes with the best weighted F1: the middle of the two values beside it."""
    order = np.argsort(-values)
    v, hit, all_ = values[order], np.cumsum((weight * (y == 1))[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (all_ + (weight * (y == 1)).sum())
    f1[:-1][v[:-1] == v[1:]] = 0  # equal values are not parted
    k = int(np.argmax(f1))
    return float((v[k] + v[min(k + 1, len(v) - 1)]) / 2)


def fit(sample: list[tuple[str, int]], share: float, seed: int = 7) -> Model:
    """Train on (text, label) rows: first every sampled window with its text's label, then, of toxic texts, only the windows that the model itself finds worst.

    One row in five is kept for the final line, whose slope is a logistic
    regression and which puts the cut with the best F1 at ``THRESHOLD``; ``share``
    is the label's share among all labelled rows, to which both are weighted.  Without rows of
    both classes every score is near 0.
    """
    rng = np.random.default_rng(seed)
    model = Model(_start(rng))
    y = np.array([label for _, label in sample], dtype=np.float32)
    if len(set(y.tolist())) < 2:
        model.slope, model.shift = 0.0, -4.0
        return model
    kept = rng.random(len(sample)) < 0.2
    if len(set(y[kept].tolist())) < 2 or len(set(y[~kept].tolist())) < 2:
        kept = np.zeros(len(sample), dtype=bool)
    place: dict[bytes, int] = {}
    codes = {k: np.array([place.setdefault(w, len(place)) for w in words_of(sample[k][0])], dtype=np.int32) for k in np.nonzero(~kept)[0]}
    vocabulary, size = _vocabulary(list(place)), len(place)
    place.clear()
    _evidence(model.p, vocabulary, list(codes.values()), y[~kept])
    ids, owner = [], []
    for k, code in codes.items():
        starts = windows_of(len(code))
        if len(starts) > ROW_WINDOWS:
            starts = rng.choice(starts, ROW_WINDOWS, replace=False)
        for s in starts:
            part = code[s : s + LENGTH]
            ids.append(np.resize(part, LENGTH))  # a short text repeats itself in training only
            owner.append(k)
    ids, owner = np.array(ids).T, np.array(owner)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    value, use, done = np.zeros(len(owner)), np.ones(len(owner), dtype=bool), 0
    batch = min(BATCH, max(16, len(owner) // 20))
    epochs = EPOCHS if len(owner) > 5000 else EPOCHS * 4
    for epoch in range(epochs):
        if epoch >= max(1, epochs // 3):  # toxic texts: their worst window, and those near it
            top = np.full(len(sample), -np.inf)
            np.maximum.at(top, owner, value)
            use = (y[owner] == 0) | (value >= top[owner] - 1e-6) | (value > np.maximum(0.0, top[owner] - 2.0))
        at = rng.permutation(np.nonzero(use)[0])
        for low in range(0, len(at), batch):
            part = at[low : low + batch]
            drop = (rng.random(size) > 0.3).astype(np.float32)
            value[part], g = _step(model.p, vocabulary, ids[:, part], y[owner[part]], drop)
            done += 1
            for k, v in model.p.items():
                m, s = moment[k]
                d = np.clip(g[k], -1, 1)
                m += 0.1 * (d - m)
                s += 0.01 * (d * d - s)
                v -= (RATE * (m / (1 - 0.9**done)) / (np.sqrt(s / (1 - 0.99**done)) + 1e-7)).astype(np.float32)
    held = np.nonzero(kept)[0] if kept.any() else np.arange(len(sample))
    values = np.concatenate([model.text_values([words_of(sample[k][0]) for k in held[low : low + 64]]) for low in range(0, len(held), 64)])
    share = min(max(share, 0.01), 0.99)
    own = y[held].mean()
    weight = np.where(y[held] == 1, share / own, (1 - share) / (1 - own))
    model.slope, _ = _line(values, y[held], weight)
    model.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - model.slope * _cut(values, y[held], weight))
    model.cache.clear()
    model.rows.clear()
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS, most_chars: int = MOST_CHARS) -> Model:
    """Fit on at most ``per_class`` labelled rows of label 0 and of label 1, of ids whose crc32 modulo 4 is not 2; null ids and labels are passed over, texts of over ``most_chars`` too."""
    sample, share = labelled_sample(docs, labels, "toxic", remainder(F.col("doc_id"), 4) != 2, per_class, most_chars)
    return fit(sample, share)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every row; null and empty texts count as one empty word.

    The model (about 1.3 MB, fixed by its constants) goes to the workers with the
    task; repeated rows give repeated scores, an empty table none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(sent.value.p, sent.value.slope, sent.value.shift)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "score": own.scores(list(batch["text"]))})

    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].alias("text"))
    scored = rows.mapInPandas(run, "id string, score double")
    return scored.select(F.col("id").cast(docs.schema[id_col].dataType).alias("doc_id"), "score")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train, then score every row: ``(doc_id, held_out, score, predicted)``.

    Null and empty texts get a score too, a null id is not held out, repeated
    rows give equal rows, an empty table none, and other columns are left aside;
    a score of exactly ``THRESHOLD`` is predicted as 1.
    """
    scored = score_toxicity(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``THRESHOLD`` or more; trains on the labelled ones among them.

    Null and empty texts are scored as one empty word, repeated rows stay or go
    together, columns of any name stay, an empty table stays empty; without
    labels of both kinds no row goes.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(sent.value.p, sent.value.slope, sent.value.shift)
        for batch in texts:
            yield pd.Series(own.scores(list(batch)), dtype="float64")

    return docs.filter(score(docs[text_col]) < THRESHOLD)
