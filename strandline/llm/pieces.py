"""SentencePiece encoding by Viterbi over an Aho-Corasick automaton of the pieces, and decoding.

One pass over the characters: at each position the automaton's output links
give every piece that ends there, and each relaxes the best score of that
position.  Characters that no chosen piece covers fall back to their UTF-8
bytes, so decoding gives every text back exactly.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words of at most so many characters are remembered, and so many of them, before a worker starts afresh.
MEMO_CHARS, MEMO = 24, 300_000
#: Rows that are encoded at once.
ROWS = 256


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id; ``kind`` is n(ormal), b(yte) or c(ontrol)."""

    pieces: list[str]
    scores: list[float]
    kinds: str


def zipf_scores(scores: list[float], kinds: str) -> list[float]:
    """Merge ranks as log probabilities by Zipf's law: the r-th piece has -ln(r) - ln(ln(n) + 0.58).

    A merge model's scores are minus the order of its merges; their sums mean
    nothing, and a best path over them would take many early pieces for one
    late word.
    """
    order = sorted((k for k in range(len(scores)) if kinds[k] == "n"), key=lambda k: -scores[k])
    out, whole = list(scores), math.log(math.log(max(len(order), 3)) + 0.58)
    for rank, k in enumerate(order, start=1):
        out[k] = -math.log(rank) - whole
    return out


def load(path: str = MODEL) -> Vocabulary:
    """Read a model's pieces on the driver; workers get them by broadcast, never by path.

    Scores that are all whole numbers of zero or less are merge ranks and become
    log probabilities; others are taken as they are.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    kinds = "".join("b" if model.is_byte(i) else "c" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "n" for i in ids)
    scores = [model.get_score(i) for i in ids]
    if all(s <= 0 and s == int(s) for s, k in zip(scores, kinds, strict=True) if k == "n"):
        scores = zipf_scores(scores, kinds)
    return Vocabulary([model.id_to_piece(i) for i in ids], scores, kinds)


@dataclass
class Codec:
    """Encoder and decoder of a vocabulary with all 256 byte pieces."""

    vocabulary: Vocabulary
    memo: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        v = self.vocabulary
        self.automaton = ahocorasick.Automaton()
        self.byte_ids, self.byte_of = [0] * 256, {}
        self.text_of: list[str] = []
        crossing = False
        normal = []
        for k, (piece, score, kind) in enumerate(zip(v.pieces, v.scores, v.kinds, strict=True)):
            if kind == "b":
                self.byte_ids[int(piece[1:-1], 16)] = k
                self.byte_of[k] = int(piece[1:-1], 16)
            elif kind == "n" and piece:
                self.automaton.add_word(piece, (k, len(piece), score))
                normal.append(score)
                crossing |= bool(re.search(f"[^{SPACE}]{SPACE}|\n", piece))
            self.text_of.append(piece.replace(SPACE, " ") if kind == "n" else "")
        self.automaton.make_automaton()
        # no piece runs on into a space mark or over a line feed, so a best path may be cut there
        self.stretch = None if crossing else re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+").findall
        self.fallback = min(normal, default=0.0) - 10.0
        self.known = frozenset(p for p, k in zip(v.pieces, v.kinds, strict=True) if k == "n" and len(p) == 1).issuperset

    def best_path(self, s: str) -> list[int]:
        """Ids with the largest sum of scores over one stretch; each character by bytes costs ``fallback``."""
        n = len(s)
        best, back = [0.0] + [-1e300] * n, [None] * (n + 1)
        if self.known(s):  # every character is a piece, and any piece beats its bytes
            for end, link in self.automaton.iter(s):
                end += 1
                value = best[end - link[1]] + link[2]
                if value > best[end]:
                    best[end], back[end] = value, link
        else:
            lost, done = self.fallback, 0
            for end, link in self.automaton.iter(s):
                end += 1
                while done < end:  # bytes of the characters passed since
                    done += 1
                    if best[done - 1] + lost > best[done]:
                        best[done] = best[done - 1] + lost
                value = best[end - link[1]] + link[2]
                if value > best[end]:
                    best[end], back[end] = value, link
        out: list[int] = []
        while n > 0:
            link = back[n]
            if link:
                out.append(link[0])
                n -= link[1]
            else:
                n -= 1
                char = " " if s[n] == SPACE else s[n]  # a text's own marks do not come here
                out += [self.byte_ids[b] for b in reversed(char.encode("utf-8", "surrogatepass"))]
        out.reverse()
        return out

    def _slow(self, s: str) -> tuple[int, ...]:
        """Ids of a marked text, stretch by stretch."""
        return tuple(k for part in (self.stretch(s) if self.stretch else [s]) for k in self.best_path(part))

    def _words(self, text: str) -> Iterable[int]:
        """Ids of a text without a mark of its own, a space before it."""
        if not self.stretch or text[:1] == " " or "  " in text:
            return self._slow(SPACE + text.replace(" ", SPACE))
        # single spaces: every word with the mark before it is cut off from the others
        words, memo = text.split(" "), self.memo
        found = list(map(memo.get, words))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    word = words[k]
                    ids = memo.get(word)
                    if ids is None:
                        ids = self._slow(SPACE + word)
                        if len(word) <= MEMO_CHARS:
                            if len(memo) >= MEMO:
                                memo.clear()
                            memo[word] = ids
                    found[k] = ids
        return chain.from_iterable(found)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text: a space mark before it, marks for spaces; a mark of its own goes by bytes.  An empty text has none."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        if SPACE not in text:
            return np.fromiter(self._words(text), dtype=np.int32)
        own = [self.byte_ids[b] for b in SPACE.encode()]
        out: list[int] = []
        for k, part in enumerate(text.split(SPACE)):
            out += own if k else []
            out += self._slow((SPACE if k == 0 else "") + part.replace(" ", SPACE))
        return np.array(out, dtype=np.int32)

    def decode(self, ids) -> str:
        """The text of ids; control ids say nothing, and bytes that are no UTF-8 become replacement marks."""
        out, held, byte_of, text_of = [], bytearray(), self.byte_of, self.text_of
        for k in ids:
            if k in byte_of:
                held.append(byte_of[k])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(text_of[k])
        if held:
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if text[:1] == " " else text


_CODECS: dict[str, Codec] = {}


def _codec(sent) -> Codec:
    """The worker's codec of a broadcast vocabulary, kept from task to task."""
    if sent.id not in _CODECS:
        _CODECS.clear()
        _CODECS[sent.id] = Codec(sent.value)
    return _CODECS[sent.id]


class _Sent(NamedTuple):
    """A broadcast vocabulary and a name for it."""

    id: str
    held: object

    @property
    def value(self) -> Vocabulary:
        return self.held.value


def _send(df: DataFrame, vocabulary: Vocabulary) -> _Sent:
    name = hashlib.sha256(repr((vocabulary.pieces, vocabulary.scores, vocabulary.kinds)).encode("utf-8", "surrogatepass")).hexdigest()
    return _Sent(name, df.sparkSession.sparkContext.broadcast(vocabulary))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            yield batch.slice(low, ROWS)


def encode_pieces(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the array ``into`` of piece ids after its own columns.

    Null and empty texts have an empty array; of equally good paths the one
    whose last piece is the longest wins, at each place; repeated rows are
    encoded alike, an empty table gives none, and columns of any name stay but
    one named ``into``, which is replaced.  The vocabulary (a fixed file) is
    broadcast.
    """
    rows = docs.drop(into)
    sent, place = _send(docs, vocabulary), rows.columns.index(text_col)
    schema = StructType([*rows.schema.fields, StructField(into, ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent)
        for batch in _slices(batches):
            ids = [codec.encode(t) for t in batch.column(place).to_pylist()]
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, into])

    return rows.mapInArrow(run, schema)


def decode_pieces(docs: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``docs`` with the text ``into`` of the ids after its own columns; null and no ids give an empty text, and a column named ``into`` is replaced."""
    rows = docs.drop(into)
    sent, place = _send(docs, vocabulary), rows.columns.index(ids_col)
    schema = StructType([*rows.schema.fields, StructField(into, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent)
        for batch in _slices(batches):
            column = pa.array([codec.decode(x or []) for x in batch.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, into])

    return rows.mapInArrow(run, schema)


def pieces_digest(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Of each document: characters, tokens, byte tokens, SHA-256 of the ids (32-bit little endian), and whether decoding gave the text back.

    Encoding and decoding share one pass, so the ids stay in the worker.  A row
    for each row; null and empty texts have no tokens and come back empty.
    """
    sent = _send(docs, vocabulary)
    rows = docs.select(docs["doc_id"].cast("string").alias("id"), docs["text"].cast("string").alias("text"))
    bytes_of = np.array([k == "b" for k in vocabulary.kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent)
        for batch in _slices(batches):
            out = []
            for text in batch.column(1).to_pylist():
                ids = codec.encode(text)
                out.append((len(text or ""), len(ids), int(bytes_of[ids].sum()), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), codec.decode(ids.tolist()) == (text or "")))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_chars", "n_tokens", "n_byte_tokens", "ids_sha256", "round_trip"])

    found = rows.mapInArrow(run, "id string, n_chars int, n_tokens int, n_byte_tokens int, ids_sha256 string, round_trip boolean")
    return found.withColumn("id", F.col("id").cast(docs.schema["doc_id"].dataType)).withColumnRenamed("id", "doc_id")
