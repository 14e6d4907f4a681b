import random
from itertools import combinations

import numpy as np
import xxhash

from strandline.llm import simhash


def _print(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(ids, prints):
    label = list(range(len(ids)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            label[root(j)] = root(i)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(ids))]


def test_matches_brute_force(docs_of, words):
    rng = random.Random(1)
    texts = [None, "", " \t\n", "one", "ONE", "two words", "É é", "x" * 50_000]
    for k in range(40):
        own = words(k, rng.randrange(3, 400))
        texts += [" ".join(own), " ".join(own)]
        for _ in range(4):
            near = list(own)
            near[rng.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
    rows = list(enumerate(texts, start=5)) + [(5, None), (None, "two words"), (6, "one")]
    found = simhash.simhash_components(docs_of(rows)).collect()
    assert len(found) == len(rows)
    prints = [_print(t) for _, t in rows]
    wanted = sorted((repr(d), f"{p:016x}", repr(c)) for (d, _), p, c in zip(rows, prints, _components([d for d, _ in rows], prints), strict=True))
    assert sorted((repr(r["doc_id"]), r["fingerprint"], repr(r["component_id"])) for r in found) == wanted


def test_empty_table(docs_of):
    assert simhash.simhash_components(docs_of([])).count() == 0 and simhash.drop_near_copies(docs_of([])).count() == 0


def test_large_keys_are_cut_and_lose_no_component(spark, monkeypatch):
    # a chain of fingerprints, each three bits from the next, in one large key
    rng = random.Random(2)
    at, chain = 0x0F0F, []
    for _ in range(300):
        chain.append(at)
        for b in rng.sample(range(64), 3):
            at ^= 1 << b
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rows = [(i, [int(np.uint64(f).astype(np.int64))]) for i, f in enumerate(dict.fromkeys(chain))]
    prints = spark.createDataFrame(rows, "id bigint, f array<bigint>")
    keys = [[(0, 0)]]  # everything shares it
    found = simhash.groups(prints, keys, 1, 3).collect()
    assert {r["component"] for r in found} == {0} and len(found) == len(rows)


def test_a_large_group_beside_others(spark, monkeypatch):
    """One key holds a dense group, a chain and strangers; with and without broadcasts, components are those of all pairs."""
    rng = random.Random(6)
    monkeypatch.setattr(simhash, "CHUNK", 16)
    prints = [0x123456789ABCDEF0 ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)]
    at = 0xFF
    for _ in range(40):
        prints.append(at)
        for b in rng.sample(range(64), 3):
            at ^= 1 << b
    prints = list(dict.fromkeys([*prints, *(rng.getrandbits(64) for _ in range(60))]))
    frame = spark.createDataFrame([(i, [int(np.uint64(f).astype(np.int64))]) for i, f in enumerate(prints)], "id bigint, f array<bigint>").repartition(3)
    wanted = dict(enumerate(_components(list(range(len(prints))), prints)))
    for most in (simhash.MOST_BROADCAST, 0):
        monkeypatch.setattr(simhash, "MOST_BROADCAST", most)
        assert {r["id"]: r["component"] for r in simhash.groups(frame, [[(0, 0)]], 1, 3).collect()} == wanted


def test_blocks_widen_with_the_rows():
    few, many = simhash.wide_keys(10**6, 0.8), simhash.wide_keys(10**10, 0.8)
    assert few == simhash.wide_keys(0, 0.8) == [[(18 * i, 18 * i + 18)] for i in range(96)]
    width = sum(b - a for a, b in many[0])
    assert 10**10 / 2**width <= simhash.CHUNK and all(b <= 64 * simhash.WIDE_WORDS for key in many for _, b in key) and len(set(map(tuple, many))) == len(many)
    rng = np.random.default_rng(1)
    for keys in (few, many):  # pairs whose bits differ as at 0.8 share a key
        differ = rng.random((4000, 64 * simhash.WIDE_WORDS)) < simhash.bit_rate(0.8)
        sums = np.concatenate([np.zeros((4000, 1), int), np.cumsum(differ, axis=1)], axis=1)
        met = np.zeros(4000, dtype=bool)
        for key in keys:
            met |= sum(sums[:, b] - sums[:, a] for a, b in key) == 0
        assert met.mean() > 0.985


def test_forest_spans():
    a, b = np.array([5, 1, 2, 9]), np.array([6, 2, 7, 10])
    node, hub = simhash._forest(a, b)
    assert dict(zip(node.tolist(), hub.tolist(), strict=True)) == {6: 5, 2: 1, 7: 1, 10: 9}


def test_near_copies_go_and_others_stay(docs_of, words):
    rows, copies = [], set()
    for k in range(30):
        own = words(100 + k, 250)
        rows.append((k, " ".join(own)))
        near = list(own)
        near[100:102] = ["quite", "other"]
        rows.append((1000 + k, " ".join(near)))  # similarity of 0.95
        copies.add(1000 + k)
        half = own[:110] + words(500 + k, 140)
        rows.append((2000 + k, " ".join(half)))  # below 0.3
    for k in range(4):  # a repeated line does not make copies
        rows.append((3000 + k, " ".join(words(900 + k, 120)) + " same line again." * 200))
    kept = simhash.drop_near_copies(docs_of([*rows, (None, rows[0][1]), (7000, None), (7001, "")]))
    assert kept.columns == docs_of([]).columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - copies | {None, 7000}


def test_similar_links_match_brute_force():
    rng = random.Random(4)
    sets = [np.unique(np.array([rng.randrange(60) for _ in range(rng.randrange(40, 160))], dtype=np.int64)) for _ in range(60)]
    part = np.array([1 + k % 2 for k in range(60)])
    for parts in (part, part * 0):
        ones = [frozenset(x.tolist()) for x in sets]
        wanted = [(i, j) for i, j in combinations(range(60), 2) if (not parts[i] or parts[i] != parts[j]) and 5 * len(ones[i] & ones[j]) >= 4 * len(ones[i] | ones[j])]
        a, b = simhash.similar_links(sets, parts, 0.8)
        assert set(zip(b, a, strict=True)) <= set(wanted)
        graphs = []
        for edges in (wanted, zip(a, b, strict=True)):
            label = list(range(60))
            for i, j in edges:
                label = [label[i] if x == label[j] else x for x in label]
            graphs.append({frozenset(k for k in range(60) if label[k] == x) for x in label})
        assert graphs[0] == graphs[1] and 1 < len(graphs[0]) < 60


def test_only_pairs_of_the_similarity_are_copies(docs_of, words, monkeypatch):
    monkeypatch.setattr(simhash, "SET_CHUNK", 400)
    rows, copies = [], set()
    for k in range(30):
        own = words(2000 + k, 304)  # 300 shingles
        rows.append((k, " ".join(own)))
        rows.append((1000 + k, " ".join(own[:267] + words(3000 + k, 37))))  # 263 of 337: 0.78
        rows.append((2000 + k, " ".join(own[:272] + words(4000 + k, 32))))  # 268 of 332: 0.807
        copies.add(2000 + k)
    ones = {d: set(simhash.shingles(t, 5)) for d, t in rows}
    near = lambda d, e: len(ones[d] & ones[e]) / len(ones[d] | ones[e])
    assert all(near(k, 1000 + k) < 0.8 <= near(k, 2000 + k) and near(1000 + k, 2000 + k) < 0.8 for k in range(30))
    for most in (simhash.MOST_BROADCAST, 0):
        monkeypatch.setattr(simhash, "MOST_BROADCAST", most)
        kept = {r["doc_id"] for r in simhash.drop_near_copies(docs_of(rows)).collect()}
        assert {d for d, _ in rows} - copies <= kept and len(kept & copies) <= 1


def test_a_large_group_of_near_copies(docs_of, words, monkeypatch):
    """Many copies of one text, each with its own change, are one group; texts half alike are not, in whichever chunks they are."""
    monkeypatch.setattr(simhash, "SET_CHUNK", 2000)
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = random.Random(3)
    own = words(1, 120)
    rows = [(0, " ".join(own))]
    for k in range(1, 150):
        near = list(own)
        at = rng.randrange(120)
        near[at : at + 1] = ["changed", str(k)]
        rows.append((k, " ".join(near)))
    rows += [(1000 + k, " ".join(own[:60] + words(50 + k, 60))) for k in range(20)]
    assert {r["doc_id"] for r in simhash.drop_near_copies(docs_of(rows)).collect()} == {0, *range(1000, 1020)}
