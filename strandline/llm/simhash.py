"""SimHash near-duplicate groups by pigeonhole blocks.

A fingerprint has ``64 * words`` bits.  Blocks are chosen so that a close pair
shares a key; rows meet on equal keys only, pairs inside a key are verified by
their Hamming distance, and every task returns a spanning forest of the links
it found, never all pairs of a group.  Equal fingerprints meet once, so groups
of exact copies cost one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.graph import connected_components
from strandline.session import checkpoint

#: Rows of one key that one task compares among themselves; a larger key is cut into chunks of this size and its chunk pairs are spread over tasks.
CHUNK = 256
#: Ids or keys (some dozen bytes each) that may be broadcast, and tasks over which the rows of a key are spread where they are more.
MOST_BROADCAST, SALTS = 400_000, 16
#: Odd multipliers that derive further 64-bit hashes from a shingle's hash.
_STEP = 0x9E3779B97F4A7C15


def shingles(text: str | None, size: int) -> list[bytes]:
    """Space-joined word shingles, repeats included; fewer words give the whole sequence, none gives nothing."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


# byte -> eight 8-bit counters in one 64-bit word; lane i counts bit i
_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=np.uint64)


def _mixed(hashes: np.ndarray, words: int) -> np.ndarray:
    """(n, words) hashes: the shingle's own first, then mixed ones."""
    if words == 1:
        return hashes[:, None].copy()
    x = hashes[:, None] + np.arange(words, dtype=np.uint64) * np.uint64(_STEP)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x[:, 0] = hashes
    return x


def fingerprint(text: str | None, size: int = 3, words: int = 1, seed: int = 42, distinct: bool = False) -> np.ndarray:
    """``words`` unsigned 64-bit words; a bit is 1 if set in over half of the shingles' hashes, repeats included unless ``distinct``."""
    parts = shingles(text, size)
    if not parts:
        return np.zeros(words, dtype=np.uint64)
    parts = list(set(parts)) if distinct else parts
    total, counts = len(parts), np.zeros((words * 8, 8), dtype=np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), dtype=np.uint64, count=total)
    for start in range(0, total, 4080):
        wide = _mixed(hashes[start : start + 4080], words)
        lanes = _LANES[wide.view(np.uint8)]  # (n, words * 8) packed counters
        for low in range(0, len(lanes), 255):
            counts += np.add.reduce(lanes[low : low + 255], axis=0).view(np.uint8).reshape(words * 8, 8)
    return np.packbits((counts * 2 > total).reshape(-1), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, words: int = 1, seed: int = 42, distinct: bool = False) -> DataFrame:
    """``(id, f array<bigint>)`` for every row, in one streamed pass over the texts.

    Null and empty texts get the zero fingerprint.  Only the two named columns are read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "f": [fingerprint(t, size, words, seed, distinct).view(np.int64) for t in batch["text"]]})

    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].alias("text"))
    found = rows.mapInPandas(run, "id string, f array<bigint>")
    return found.select(F.col("id").cast(docs.schema[id_col].dataType).alias("id"), "f")


def _bits(low: int, high: int) -> F.Column:
    """Bits [low, high) of the fingerprint ``f``, within one or two of its words."""
    word, shift = divmod(low, 64)
    width = high - low
    value = F.shiftrightunsigned(F.col("f")[word], shift)
    if shift + width > 64:
        value = value.bitwiseOR(F.shiftleft(F.col("f")[word + 1], 64 - shift))
    return value.bitwiseAND(F.lit((1 << width) - 1))


def exact_keys(bits: int, distance: int, blocks: int) -> list[list[tuple[int, int]]]:
    """Keys of several blocks each: two fingerprints that differ in ``distance`` bits agree in ``blocks - distance`` of the blocks, so they share a key."""
    edges = [bits * i // blocks for i in range(blocks + 1)]
    return [[(edges[i], edges[i + 1]) for i in kept] for kept in combinations(range(blocks), blocks - distance)]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links between row numbers."""
    label = np.arange(int(max(a.max(), b.max())) + 1)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    node = np.unique(np.concatenate([a, b]))
    node = node[label[node] != node]
    return node, label[node]


def _verifier(words: int, distance: int):
    """Rows of (g, part, root, f0..) sorted by g in, a spanning forest (a, b) of each group's links between different roots out."""

    def verified(rows: pd.DataFrame) -> pd.DataFrame:
        g, part, root = rows["g"].to_numpy(), rows["part"].to_numpy(), rows["root"].to_numpy()
        f = [rows[f"f{k}"].to_numpy().view(np.uint64) for k in range(words)]
        ends_a, ends_b = [], []
        here = np.arange(len(g))
        lag = 1
        while True:
            here = here[: np.searchsorted(here, len(g) - lag)]
            here = here[g[here] == g[here + lag]]
            if not len(here):
                break
            there = here + lag
            # part: 0 all pairs of the chunk, else only pairs between the two chunks
            open_ = (root[here] != root[there]) & ((part[here] == 0) | (part[here] != part[there]))
            one, two = here[open_], there[open_]
            apart = np.zeros(len(one), dtype=np.int32)
            for x in f:
                apart += np.bitwise_count(x[one] ^ x[two])
            ends_a.append(one[apart <= distance])
            ends_b.append(two[apart <= distance])
            lag += 1
        a, b = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (ends_a, ends_b))
        if not len(a):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        names, place = np.unique(root, return_inverse=True)
        a, b = _forest(place[a], place[b])
        return pd.DataFrame({"a": names[a], "b": names[b]})

    return verified


def _whole_groups(verified):
    """Rows sorted by g in; ``verified`` gets whole groups, also those that go on in the next batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            g = rows["g"].to_numpy()
            same = int(np.argmax(g[::-1] != g[-1])) if len(g) and g[0] != g[-1] else len(g)
            last = len(g) - same  # the last group may go on in the next batch
            kept = rows.iloc[last:]
            if last:
                yield verified(rows.iloc[:last])
        if kept is not None and len(kept):
            yield verified(kept)

    return run


def _spread(rows: DataFrame, table: DataFrame, on: str, by: str) -> DataFrame:
    """``rows`` left-joined with a checkpointed table of one row for each ``on``.

    Few of them are broadcast.  Otherwise the rows of a key go to ``SALTS`` tasks
    by a hash of ``by``, so that the rows of a large group do not share one.
    """
    if table.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(table), on, "left")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(by, F.lit(11)), F.lit(SALTS)))
    table = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return rows.join(table, [on, "salt"], "left").drop("salt")


def _cut(rows: DataFrame, on: str, label: str, weight: F.Column, most: int) -> DataFrame:
    """``(on, inside, n_in, n_out)`` of the groups that weigh over ``most``: the label of the greatest part of them, and the chunks of the rows with it and of the others."""
    per = rows.groupBy(on, label).agg(F.sum(weight).alias("w"))
    whole = per.groupBy(on).agg(F.sum("w").alias("t"), F.max("w").alias("m"), F.max_by(label, F.struct("w", label)).alias("inside")).filter(F.col("t") > most)
    return whole.select(on, "inside", F.ceil(F.col("m") / most).cast("int").alias("n_in"), F.ceil((F.col("t") - F.col("m")) / most).cast("int").alias("n_out"))


def _chunk_pairs(rows: DataFrame, cut: DataFrame, on: str, label: str, by: str) -> DataFrame:
    """Rows once for each pair ``c`` of chunks that theirs is in; a group that is not in ``cut`` is one chunk.

    Rows with a group's inside label are linked already, so their chunks meet
    those of the others only: a large group most of which is one component costs
    as much as it has rows, times the chunks of the rest.
    """
    rows = _spread(rows, cut, on, by).filter("n_out is null or n_out > 0")
    hashed = F.xxhash64(by, F.lit(7))
    inner = F.col(label) == F.col("inside")
    own = F.when(inner, F.col("n_out") + F.pmod(hashed, F.col("n_in"))).otherwise(F.pmod(hashed, F.col("n_out"))).cast("int")
    last = F.when(inner, F.col("n_out") - 1).otherwise(F.col("n_out") + F.col("n_in") - 1)
    pairs = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.least(i, own).alias("s0"), F.greatest(i, own).alias("s1"), F.when(i == own, 0).when(i > own, 1).otherwise(2).alias("part")))
    none = F.array(F.struct(F.lit(0).alias("s0"), F.lit(0).alias("s1"), F.lit(0).alias("part")))
    return rows.withColumn("c", F.explode(F.when(F.col("n_out").isNull(), none).otherwise(pairs)))


def _scattered(cut: DataFrame) -> bool:
    """Whether some group has more than a chunk of rows outside its greatest part."""
    return not cut.filter("n_out > 1").isEmpty()


def _own_chunks(rows: DataFrame, cut: DataFrame, on: str, by: str, salt: int) -> DataFrame:
    """Rows of the groups in ``cut``, each in one chunk ``c`` of its group."""
    n = F.col("n_in") + F.col("n_out")
    own = F.pmod(F.xxhash64(by, F.lit(100 + salt)), n).cast("int")
    rows = _spread(rows, cut, on, by).filter("n_in is not null")
    return rows.withColumn("c", F.struct(own.alias("s0"), own.alias("s1"), F.lit(0).alias("part")))


def _compared(rows: DataFrame, on: str, columns: list[str], compare) -> DataFrame:
    """The links ``(a, b)`` that ``compare`` finds in each group and pair of chunks ``c``."""
    rows = rows.select(F.xxhash64(on, "c.s0", "c.s1").alias("g"), F.col("c.part").cast("tinyint").alias("part"), *columns)
    return rows.repartition("g").sortWithinPartitions("g").mapInPandas(_whole_groups(compare), "a bigint, b bigint")


def _merged(nodes: DataFrame, label: str, found: DataFrame) -> DataFrame:
    """``nodes`` with the labels that the links join made one; checkpointed if that moves them, and else to be read with the small table of new labels."""
    moved = checkpoint(connected_components(found).filter("node <> component").select(F.col("node").alias(label), F.col("component").alias("joined")))
    rows = _spread(nodes, moved, label, "node").withColumn(label, F.coalesce("joined", label)).drop("joined")
    return rows if moved.count() <= MOST_BROADCAST else checkpoint(rows)


def links(nodes: DataFrame, keys: list[list[tuple[int, int]]], words: int, distance: int, first_key: int = 0) -> DataFrame:
    """``nodes`` (node, least, root, f) with one root for those that share a key and differ in at most ``distance`` bits of their first ``words`` words.

    Every close pair with a common key counts.  The rows are shuffled once; keys
    with many rows are counted before.  Their rows are first compared within
    chunks of ``CHUNK``, which makes one component of most of a large group of
    copies; then all pairs of chunks are but those inside that component.
    """
    tags = [F.xxhash64(F.lit(first_key + k), *(_bits(low, high) for low, high in blocks)) for k, blocks in enumerate(keys)]
    f = [f"f{k}" for k in range(words)]
    tagged = lambda x: x.select("node", "root", *(F.col("f")[k].alias(f"f{k}") for k in range(words)), F.explode(F.array(*tags)).alias("key"))
    compare = _verifier(words, distance)
    large = checkpoint(tagged(nodes).groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > CHUNK))
    label = lambda x: checkpoint(_cut(_spread(tagged(x).select("key", "root", "node"), large, "key", "node").filter("m is not null"), "key", "root", F.lit(1), CHUNK))
    cut = large.select("key", *(F.lit(None).cast(kind).alias(c) for c, kind in (("inside", "bigint"), ("n_in", "int"), ("n_out", "int"))))
    if not large.isEmpty():
        cut = label(nodes)
        if _scattered(cut):
            nodes = _merged(nodes, "root", _compared(_own_chunks(tagged(nodes), cut, "key", "node", first_key), "key", ["root", *f], compare))
            cut = label(nodes)
    return _merged(nodes, "root", _compared(_chunk_pairs(tagged(nodes), cut, "key", "root", "node"), "key", ["root", *f], compare))


def _rooted(tagged: DataFrame, keys: list[list[tuple[int, int]]], check: int, distance: int, rounds: int) -> DataFrame:
    """``(node, least, root)`` of the distinct fingerprints of ``(id, f, node)``: linked ones have one root, ``least`` is a node's least id."""
    nodes = checkpoint(tagged.groupBy("node").agg(F.min("id").alias("least"), F.first("f").alias("f")).withColumn("root", F.col("node")))
    for r in range(rounds):
        low, high = len(keys) * r // rounds, len(keys) * (r + 1) // rounds
        nodes = links(nodes, keys[low:high], check, distance, low)
        nodes = checkpoint(nodes if r < rounds - 1 else nodes.select("node", "least", "root"))
    return nodes


def _shared(nodes: DataFrame) -> DataFrame:
    """``(root, component)`` of the roots of more than one node, checkpointed; the component is the least id."""
    shared = nodes.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("m")).filter("m > 1").select("root", "component")
    return checkpoint(shared)


def _named(tagged: DataFrame, nodes: DataFrame) -> DataFrame:
    named = _spread(nodes, _shared(nodes), "root", "node").select("node", F.coalesce("component", "least").alias("component"))
    return tagged.join(named, "node").select("id", "f", "component")


def groups(prints: DataFrame, keys: list[list[tuple[int, int]]], check: int, distance: int, rounds: int = 1) -> DataFrame:
    """``(id, f, component)``: the component is the least id reachable over links.

    ``prints`` must be cheap to reread (a checkpoint).  The keys are used in
    ``rounds``; what one has joined, the next takes as one, so a large group of
    near copies is linked once rather than under every key.  Null ids take part
    but name no component; a component of null ids only has a null name.
    """
    tagged = prints.withColumn("node", F.xxhash64("f"))
    return _named(tagged, _rooted(tagged, keys, check, distance, rounds))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = 3, blocks: int = 5, seed: int = 42) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row: 64-bit fingerprints linked at ``distance`` or fewer differing bits.

    Exact: ``blocks`` blocks and keys of ``blocks - distance`` of them leave no
    close pair without a common key.  Null and empty texts share the zero
    fingerprint; repeated rows come back as often as they occur; a null id gets
    its group's least id; an empty table gives no rows.
    """
    prints = checkpoint(fingerprints(docs, id_col, text_col, size, 1, seed))
    found = groups(prints, exact_keys(64, distance, blocks), 1, distance)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex(F.col("f")[0]), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


#: The wide form of the pipeline: words of a fingerprint, those that gate a pair, rounds of keys, bits of a block at least, and the share of pairs at the similarity that no block may miss.
WIDE_WORDS, WIDE_CHECK, WIDE_ROUNDS, WIDE_BITS, WIDE_MISSED = 27, 4, 4, 18, 0.006
#: Shingles of the sets that one task compares among themselves, a set counting as ``SET_LEAST`` more; a larger candidate group is cut into chunks, as a key's rows are.
SET_CHUNK, SET_LEAST = 100_000, 100


def bit_rate(similarity: float) -> float:
    """Share of bits that differ at a Jaccard similarity of shingle sets: angle over pi, as the cosine is 2J / (1 + J)."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def wide_keys(rows: int, similarity: float) -> list[list[tuple[int, int]]]:
    """Blocks of the wide fingerprint, so wide that some ``CHUNK`` of so many rows share one by chance, and so many that a pair at the similarity meets in one but for ``WIDE_MISSED``.

    Blocks are apart while there are bits for them; beyond, they are pairs of
    half blocks, each of which is used several times, and half as many more make
    up for that.
    """
    width = max(WIDE_BITS, int(np.ceil(np.log2(max(rows, 1) / CHUNK))))
    count = int(np.ceil(np.log(WIDE_MISSED) / np.log1p(-((1 - bit_rate(similarity)) ** width))))
    if count * width <= 64 * WIDE_WORDS:
        return [[(width * i, width * (i + 1))] for i in range(count)]
    half = -(-width // 2)
    parts = 64 * WIDE_WORDS // half
    pairs = [(i, (i + step) % parts) for step in range(1, parts // 2) for i in range(parts)]
    return [[(half * i, half * (i + 1)), (half * j, half * (j + 1))] for i, j in pairs[: count + count // 2]]


def wide_distance(similarity: float, bits: int) -> int:
    """Differing bits at the similarity, and three standard deviations more."""
    rate = bit_rate(similarity)
    return int(np.ceil(bits * rate + 3 * np.sqrt(bits * rate * (1 - rate))))


def shingle_set(text: str | None, size: int, seed: int = 42) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, rising."""
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles(text, size), repeat(seed)), dtype=np.uint64))


def similar_links(sets: list[np.ndarray], part: np.ndarray, similarity: float, label: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """A forest that spans what the pairs of sets with a Jaccard similarity of at least ``similarity`` join; of parts other than 0, only pairs between the two; sets of one ``label`` are joined already."""
    size = np.array([len(x) for x in sets])
    ends = np.cumsum(size)
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(len(token), dtype=bool)
    label, ends_a, ends_b = np.arange(len(sets)) if label is None else label.copy(), [], []
    for d in range(1, len(sets)):
        own = token[ends[d] - size[d] : ends[d]]
        mark[own] = True
        open_ = ((part[:d] == 0) | (part[:d] != part[d])) & (np.minimum(size[:d], size[d]) >= similarity * np.maximum(size[:d], size[d]) - 1e-9) & (size[:d] > 0)
        for first in (True, False):  # one of each group, then the rest of the groups that are still others
            other = np.flatnonzero(open_ & (label[:d] != label[d]))
            if first:
                other = other[np.unique(label[other], return_index=True)[1]]
            if not len(other):
                continue
            if 8 * len(other) < d:
                shared = np.array([np.count_nonzero(mark[token[ends[k] - size[k] : ends[k]]]) for k in other])
            else:
                sums = np.concatenate([[0], np.cumsum(mark[token[: ends[d - 1]]])])
                shared = sums[ends[other]] - sums[ends[other] - size[other]]
            for k in other[shared * (1 + similarity) >= similarity * (size[other] + size[d]) - 1e-9].tolist():
                if label[k] != label[d]:
                    label[label == label[k]] = label[d]
                    ends_a.append(d)
                    ends_b.append(k)
        mark[own] = False
    return ends_a, ends_b


def _exact(similarity: float):
    """Rows of (g, part, label, s) sorted by g in, a forest (a, b) of the labels that each group's similar sets join out."""

    def verified(rows: pd.DataFrame) -> pd.DataFrame:
        g, part, label, sets = (rows[c].to_numpy() for c in ("g", "part", "label", "s"))
        cuts = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
        ends_a, ends_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            names, place = np.unique(label[low:high], return_inverse=True)
            a, b = similar_links(list(sets[low:high]), part[low:high], similarity, place) if len(names) > 1 else ([], [])
            ends_a.append(label[low:high][a])
            ends_b.append(label[low:high][b])
        return pd.DataFrame({"a": np.concatenate(ends_a), "b": np.concatenate(ends_b)})

    return verified


def _of_ids(docs: DataFrame, id_col: str, ids: DataFrame, how: str) -> DataFrame:
    """``docs`` joined by one of the ``left_`` kinds with the checkpointed ``_id`` of ``ids``, broadcast if they are few."""
    if ids.count() <= MOST_BROADCAST:  # a few megabytes; beyond it the texts are shuffled
        ids = F.broadcast(ids)
    return docs.join(ids, docs[id_col] == ids["_id"], how)


def _similar_nodes(docs: DataFrame, id_col: str, text_col: str, size: int, similarity: float, tagged: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` whose roots hold only what links of at least ``similarity`` join; all pairs below a root are judged on their shingle sets."""
    asked = checkpoint(_spread(nodes, _shared(nodes), "root", "node").filter("component is not null or least is null").select("node", "root", "least"))
    # one document of each node is read again, and those without an id
    ids = checkpoint(asked.select(F.col("least").alias("_id")).filter("_id is not null").distinct())
    texts = docs.select(docs[id_col], docs[text_col])
    texts = _of_ids(texts, id_col, ids, "left_semi").unionByName(texts.filter(docs[id_col].isNull())).select(F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 500):
                t = batch["text"].iloc[low : low + 500]
                f = [fingerprint(x, size, WIDE_WORDS, distinct=True).view(np.int64) for x in t]
                yield pd.DataFrame({"f": f, "s": [shingle_set(x, size).view(np.int64) for x in t]})

    sets = texts.mapInPandas(run, "f array<bigint>, s array<bigint>").select(F.xxhash64("f").alias("node"), "s")
    sets = sets.join(asked.select("node", "root"), "node").groupBy("node", "root").agg(F.min("s").alias("s")).withColumn("label", F.col("node"))
    sets, size, compare = checkpoint(sets), F.size("s") + SET_LEAST, _exact(similarity)
    cut = checkpoint(_cut(sets, "root", "label", size, SET_CHUNK))
    for salt in range(2):  # within chunks, which differ from one time to the other
        if _scattered(cut):
            sets = _merged(sets, "label", _compared(_own_chunks(sets, cut, "root", "node", salt), "root", ["label", "s"], compare))
            cut = checkpoint(_cut(sets, "root", "label", size, SET_CHUNK))
    sets = _merged(sets, "label", _compared(_chunk_pairs(sets, cut, "root", "label", "node"), "root", ["label", "s"], compare))
    return checkpoint(nodes.join(sets.select("node", "label"), "node", "left").select("node", "least", F.coalesce("label", "node").alias("root")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without the members of near-copy groups other than the one with the least id.

    A group is what pairs of a Jaccard similarity of at least ``similarity``
    link, which is judged on the whole shingle sets (by 64-bit hashes).  Pairs are
    judged if a wide fingerprint links them: at a similarity of 0.8 about a
    seventh of the bits differ, too many for the pigeonhole guarantee on 64 bits;
    so the fingerprint is 1728 bits wide, and up to some 10^8 rows a pair meets in
    at least one of its 96 blocks of 18 bits with a probability of 0.994 at 0.8
    and above 0.999 from 0.84 on, and passes a gate of three standard deviations
    on 256 bits with 0.998; together 0.99 at 0.8.  Beyond, the blocks are wider
    and more (``wide_keys``).  Such pairs and what they chain are judged all
    against all, but for those that are joined already.  Shingles count once, as
    in the sets that are compared, so that a line repeated many times does not
    make two texts alike.

    Rows of one id are one document and stay or go together; rows with a null id
    always stay.  Null texts are empty, and empty texts are one group; ties do
    not arise, as the least id is one id.  An empty table stays empty, and columns
    of any name are kept as they are.
    """
    keys, distance = wide_keys(docs.count(), similarity), wide_distance(similarity, 64 * WIDE_CHECK)
    prints = checkpoint(fingerprints(docs, id_col, text_col, size, WIDE_WORDS, distinct=True))
    tagged = prints.withColumn("node", F.xxhash64("f"))
    nodes = _rooted(tagged, keys, WIDE_CHECK, distance, WIDE_ROUNDS)
    found = _named(tagged, _similar_nodes(docs, id_col, text_col, size, similarity, tagged, nodes))
    gone = checkpoint(found.filter("id <> component").select(F.col("id").alias("_id")).distinct())
    return _of_ids(docs, id_col, gone, "left_anti")
