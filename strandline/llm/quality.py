"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  A line's own features and those of the lines beside
it give its unary value, neighbouring labels share transition weights, and the
length-weighted mean of the forward-backward marginals is the document's
quality, put through a fitted line.  Trained in numpy on the driver from a
bounded sample; scoring streams over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.sampling import labelled_sample, remainder
from strandline.llm.toxicity import _line

#: Bounds of the training sample: rows of each class, characters of a row.
PER_CLASS, MOST_CHARS = 1500, 20_000
STEPS, RATE, ROUNDS = 120, 0.05, 3
THRESHOLD = 0.3
#: Characters and lines of text that are scored at once; a longer text is scored alone, its lines in blocks of so many.
AT_ONCE, LINES_AT_ONCE = 2_000_000, 50_000
#: Lines of a chain that are passed one by one.
PIECE = 512

_CLASSES = ["lower", "upper", "digit", "space", "stop", "comma", "symbol", "other", "newline"]


def _class(b: int) -> int:
    c = chr(b)
    if b == 10:
        return 8
    if b >= 128:
        return 7
    if c.isspace() or b < 32:
        return 3
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 4 if c in ".!?" else 5 if c in ",;:'\"()-" else 6


_LOOKUP = np.array([_class(b) for b in range(256)], dtype=np.uint8)
OWN = 16
FEATURES = 3 * OWN + 1


class Lines:
    """The lines of some texts: ``size`` in bytes, ``counts`` of each text (an empty text has one empty line), and how often a line occurs in its text (``again``)."""

    def __init__(self, texts: list[str | None]) -> None:
        blobs = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.lines = [x for b in blobs for x in b.split(b"\n")]
        self.counts = np.array([b.count(b"\n") + 1 for b in blobs], dtype=np.int64)
        self.size = np.fromiter(map(len, self.lines), dtype=np.int64, count=len(self.lines))
        self.first = np.cumsum(self.counts) - self.counts
        # one number for a line and its text
        doc = np.repeat(np.arange(len(texts), dtype=np.uint64), self.counts)
        code = np.fromiter(map(hash, self.lines), dtype=np.int64, count=len(self.lines)).view(np.uint64)
        code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + doc * np.uint64(0x9E3779B97F4A7C15)
        _, where, times = np.unique(code, return_inverse=True, return_counts=True)
        self.again = times[where]
        self.again[self.size == 0] = 1

    def own(self, low: int, high: int) -> np.ndarray:
        """Features of the lines from ``low`` to before ``high`` alone."""
        lines, size = self.lines[low:high], self.size[low:high]
        whole = np.frombuffer(b"\n".join(lines) + b"\n", dtype=np.uint8)
        of = np.repeat(np.arange(len(lines)), size + 1)
        n = np.bincount(of * len(_CLASSES) + _LOOKUP[whole], minlength=len(lines) * len(_CLASSES)).reshape(-1, len(_CLASSES)).astype(np.float64)
        words = [x.split() for x in lines]
        total = np.fromiter(map(len, words), dtype=np.float64, count=len(lines))
        fresh = np.fromiter((len(set(w)) for w in words), dtype=np.float64, count=len(lines))
        marked = np.fromiter((sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:!?" for w in ws) for ws in words), dtype=np.float64, count=len(lines))
        length, safe = size.astype(np.float64), np.maximum(size, 1)
        last = whole[np.maximum(np.cumsum(size + 1) - 2, 0)]
        letters = np.maximum(n[:, 0] + n[:, 1], 1)
        of_text = self.counts[np.searchsorted(self.first, np.arange(low, high), side="right") - 1]
        return np.stack(
            [
                np.log1p(length) / 5,
                (size == 0).astype(float),
                n[:, 1] / letters,
                4 * n[:, 2] / safe,
                n[:, 3] / safe,
                4 * n[:, 4] / safe,
                4 * n[:, 5] / safe,
                4 * n[:, 6] / safe,
                np.minimum(n[:, 6], 20) / 10,
                np.log1p(self.again[low:high] - 1),
                1 - fresh / np.maximum(total, 1),
                marked / np.maximum(total, 1),
                np.isin(last, list(b".!?")) * (size > 0),
                np.minimum(length / np.maximum(total, 1), 30) / 10,
                (total < 4).astype(float),
                np.log1p(of_text) / 4,
            ],
            axis=1,
        )

    def features(self, low: int, high: int) -> np.ndarray:
        """Features of the lines from ``low`` to before ``high``, those of the lines beside them in the same text, and a 1."""
        start, stop = max(low - 1, 0), min(high + 1, len(self.lines))
        own = self.own(start, stop)
        own = np.vstack([np.zeros((1, OWN))] * (start == low) + [own] + [np.zeros((1, OWN))] * (stop == high))
        before, here, after = own[:-2].copy(), own[1:-1], own[2:].copy()
        ends = self.first + self.counts - 1
        before[self.first[(self.first >= low) & (self.first < high)] - low] = 0
        after[ends[(ends >= low) & (ends < high)] - low] = 0
        return np.hstack([here, before, after, np.ones((len(here), 1))])

    def blocks(self) -> Iterator[tuple[int, int]]:
        """Ranges of lines that are looked at at once: bounded in lines, and in bytes but for a longer line."""
        bytes_to = np.cumsum(self.size + 1)
        low = 0
        while low < len(self.size):
            done = bytes_to[low - 1] if low else 0
            high = max(low + 1, min(low + LINES_AT_ONCE, int(np.searchsorted(bytes_to, done + AT_ONCE, side="right"))))
            yield low, min(high, len(self.size))
            low = high


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths in bytes, and the number of lines of each text (an empty text has one empty line)."""
    lines = Lines(texts)
    return np.vstack([lines.features(low, high) for low, high in lines.blocks()]), lines.size, lines.counts


def _passed(a: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log odds ``a`` of a line's label as those that it gives the next line's."""
    return np.logaddexp(a + t[1, 1], t[0, 1]) - np.logaddexp(a + t[1, 0], t[0, 0])


def _forward(unary: np.ndarray, trans: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log odds of forward messages, with the line's own value, for all chains side by side.

    A chain of over ``PIECE`` lines is cut into pieces of about the root of its
    length: what each does to a message is a 2 x 2 table, worked out for all
    pieces side by side; then messages pass from piece to piece, and all pieces
    are run again from the message that reaches them.
    """
    cuts = np.maximum(PIECE, np.ceil(np.sqrt(counts)).astype(np.int64))
    per = -(-counts // cuts)
    chain = np.repeat(np.arange(len(counts)), per)
    place = np.arange(len(chain)) - np.repeat(np.cumsum(per) - per, per)
    start = (np.cumsum(counts) - counts)[chain] + place * cuts[chain]
    length = np.minimum(cuts[chain], counts[chain] - place * cuts[chain])
    into = np.full(len(chain), np.nan)  # the log odds before a piece; none before a chain
    passing = np.flatnonzero(place < per[chain] - 1)
    if len(passing):
        # table[i, j]: log weight of all labellings of a piece that end in j, after label i
        table = np.zeros((2, 2, len(passing)))
        begin = place[passing] == 0
        order = np.argsort(-length[passing], kind="stable")
        at, size = start[passing][order], length[passing][order]
        done = np.full((2, 2, len(order)), -np.inf)
        done[0, 0] = done[1, 1] = 0.0
        for k in range(int(size[0])):
            n = int(np.searchsorted(-size, -k, side="left"))  # pieces of more than k lines
            u = unary[at[:n] + k]
            new = [[np.logaddexp(done[i, 0, :n] + trans[0, j], done[i, 1, :n] + trans[1, j]) + j * u for j in (0, 1)] for i in (0, 1)]
            if k == 0:  # nothing passes into the first line of a chain
                for i in (0, 1):
                    for j in (0, 1):
                        new[i][j] = np.where(begin[order][:n], j * u, new[i][j])
            done[:, :, :n] = new
        table[:, :, order] = done
        odds = 0.0
        for k, piece in enumerate(passing.tolist()):
            (a, b), (c, d) = table[:, :, k].tolist()
            odds = (b - a) if begin[k] else float(np.logaddexp(odds + d, b) - np.logaddexp(odds + c, a))
            into[piece + 1] = odds
    forward = np.empty_like(unary)
    order = np.argsort(-length, kind="stable")
    at, size = start[order], length[order]
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k, side="left"))
        before = into[order][:n] if k == 0 else forward[at[:n] + k - 1]
        forward[at[:n] + k] = unary[at[:n] + k] + np.where(np.isnan(before), 0.0, _passed(np.nan_to_num(before), trans))
    return forward


def _chain(unary: np.ndarray, trans: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of forward messages (with the line's own value) and of backward messages, for all chains side by side.

    ``unary`` is a line's value of good over bad, ``trans[i, j]`` the value of
    label i before label j.
    """
    backward = _forward(unary[::-1], trans.T, counts[::-1])[::-1] - unary
    return _forward(unary, trans, counts), backward


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Unary weights (of features scaled by ``mean`` and ``scale``), transitions, and the final line."""

    weights: np.ndarray
    trans: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def unary(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights

    def marginals(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Probability that each line is good."""
        return _sigmoid(sum(_chain(self.unary(features), self.trans, counts)))

    def qualities(self, texts: list[str | None]) -> np.ndarray:
        """Length-weighted mean marginal of each text, as log odds; a line leaves only its value behind, so that long texts do not pile up features."""
        lines = Lines(texts)
        unary = np.concatenate([self.unary(lines.features(low, high)) for low, high in lines.blocks()])
        weight = lines.size + 1.0
        good = _sigmoid(sum(_chain(unary, self.trans, lines.counts)))
        mean = np.add.reduceat(good * weight, lines.first) / np.add.reduceat(weight, lines.first)
        mean = np.clip(mean, 1e-4, 1 - 1e-4)
        return np.log(mean / (1 - mean))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability that each text is good."""
        out, low, held, lines = [], 0, 0, 0
        for k, text in enumerate(texts):
            held += len(text or "")
            lines += (text or "").count("\n") + 1
            if held >= AT_ONCE or lines >= LINES_AT_ONCE or k == len(texts) - 1:
                out.append(self.qualities(texts[low : k + 1]))
                low, held, lines = k + 1, 0, 0
        return _sigmoid(self.slope * np.concatenate(out) + self.shift) if out else np.zeros(0)


def _train_chain(features: np.ndarray, counts: np.ndarray, labels: np.ndarray, model: Model, steps: int) -> None:
    """Climb the log likelihood of full line labellings with Adam steps."""
    x = (features - model.mean) / model.scale
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    inner = np.ones(len(x), dtype=bool)
    inner[first] = False  # lines that have one before them
    at = np.nonzero(inner)[0]
    share = (1 / np.sqrt(counts))[doc]  # so that long documents do not drown short ones
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[at - 1], labels[at]), share[at])
    m = [np.zeros_like(model.weights), np.zeros((2, 2))]
    s = [np.zeros_like(model.weights), np.zeros((2, 2))]
    for step in range(1, steps + 1):
        unary = x @ model.weights
        forward, backward = _chain(unary, model.trans, counts)
        p = _sigmoid(forward + backward)
        pair = np.stack([model.trans[i, j] + i * forward[at - 1] + j * (unary[at] + backward[at]) for i in (0, 1) for j in (0, 1)])
        pair = np.exp(pair - pair.max(0))
        pair = (pair / pair.sum(0) * share[at]).sum(1).reshape(2, 2)
        norm = share.sum()
        grads = [(x.T @ (share * (labels - p))) / norm - 1e-3 * model.weights, (seen - pair) / norm - 1e-3 * model.trans]
        for k, value in enumerate((model.weights, model.trans)):
            m[k] += 0.1 * (grads[k] - m[k])
            s[k] += 0.01 * (grads[k] ** 2 - s[k])
            value += RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)


def fit(sample: list[tuple[str, int]], share: float, seed: int = 7) -> Model:
    """Train on (text, label) rows.

    Lines first take their text's label; then, round by round, the lines of bad
    texts that the model finds good are relabelled, but at least the worst line
    stays bad.  One row in five is kept for the final line, weighted to
    ``share``, the label's share among all labelled rows.  Without rows of both
    classes every score is the share itself (1 if nothing is labelled).
    """
    y = np.array([label for _, label in sample], dtype=np.int64)
    model = Model(np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(FEATURES), np.ones(FEATURES))
    if len(set(y.tolist())) < 2:
        model.slope, model.shift = 0.0, 9.0 if not len(y) or y[0] else -9.0
        return model
    rng = np.random.default_rng(seed)
    kept = rng.random(len(y)) < 0.2
    if len(set(y[kept].tolist())) < 2 or len(set(y[~kept].tolist())) < 2:
        kept = np.zeros(len(y), dtype=bool)
    features, _, counts = line_features([t for (t, _), k in zip(sample, kept, strict=True) if not k])
    own = y[~kept]
    model.mean, model.scale = features.mean(0), features.std(0) + 1e-6
    model.mean[-1], model.scale[-1] = 0, 1
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    labels = own[doc]
    for _ in range(ROUNDS):
        _train_chain(features, counts, labels, model, STEPS)
        p = model.marginals(features, counts)
        worst = np.minimum.reduceat(p, first)
        labels = np.where(own[doc] == 1, 1, ((p > 0.7) & (p > worst[doc])).astype(np.int64))
    held = np.nonzero(kept)[0] if kept.any() else np.arange(len(y))
    values = model.qualities([sample[k][0] for k in held])
    share = min(max(share, 0.01), 0.99)
    weight = np.where(y[held] == 1, share / y[held].mean(), (1 - share) / (1 - y[held].mean()))
    model.slope, model.shift = _line(values, y[held], weight)
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_chars: int = MOST_CHARS) -> Model:
    """Fit on at most ``per_class`` labelled rows a class, of ids whose crc32 modulo 5 is not 0; null ids and labels are passed over, texts of over ``most_chars`` too."""
    sample, share = labelled_sample(docs, labels, "quality", remainder(F.col("doc_id"), 5) != 0, (per_class, per_class), most_chars)
    return fit(sample, share)


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every row; null and empty texts have one empty line.

    A text of any length is scored whole, at some hundred bytes of memory a line.
    Repeated rows give equal scores, an empty table none, and other columns are
    left aside.  The model is some hundred numbers and goes to the workers with
    the task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "score": model.scores(list(batch["text"]))})

    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].alias("text"))
    scored = rows.mapInPandas(run, "id string, score double")
    return scored.select(F.col("id").cast(docs.schema[id_col].dataType).alias("doc_id"), "score")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train, then score every row: ``(doc_id, held_out, score, predicted)``.

    Null and empty texts get a score too, a null id is not held out, repeated
    rows give equal rows, an empty table none, and other columns are left aside;
    a score of exactly ``THRESHOLD`` is predicted as 1.
    """
    scored = score_quality(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
