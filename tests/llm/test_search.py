"""Pieces, top-k search, decontamination and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import decontaminate, pieces, topk

TEXTS = [None, "", " ", "  two  spaces ", "▁marks▁ ▁", "\n\n line\nfeeds \n", "é😀\u0000​", "<0x0A><s></s><unk>", "a" * 30_000, " " * 3000, "plain words, and more of them."]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def test_pieces_round_trip(docs_of, vocabulary):
    rows = list(enumerate(TEXTS)) + [(3, "  two  spaces "), (None, "x")]
    encoded = pieces.encode_pieces(docs_of(rows).drop("ids"), vocabulary)
    decoded = pieces.decode_pieces(encoded, vocabulary)
    assert decoded.columns == [*docs_of([]).drop("ids").columns, "ids", "decoded"]
    got = decoded.select("doc_id", "text", "decoded").collect()
    assert len(got) == len(rows) and all(r["decoded"] == (r["text"] or "") for r in got)
    digest = pieces.pieces_digest(docs_of(rows), vocabulary).collect()
    assert all(r["round_trip"] for r in digest) and len(digest) == len(rows)
    assert pieces.pieces_digest(docs_of([]), vocabulary).count() == 0 and pieces.encode_pieces(docs_of([]), vocabulary).count() == 0


def test_paths_have_the_best_score(vocabulary, words):
    codec = pieces.Codec(vocabulary)
    score = {p: s for p, s, k in zip(vocabulary.pieces, vocabulary.scores, vocabulary.kinds, strict=True) if k == "n"}
    for text in [" ".join(words(k, 40)) for k in range(20)] + ["The  quick brown fox\nover 13 dogs, ünï 漢字 ok"]:
        marked = "▁" + text.replace(" ", "▁")
        best = [0.0]
        for end in range(1, len(marked) + 1):
            best.append(max([best[end - 1] + codec.fallback] + [best[b] + score[marked[b:end]] for b in range(max(0, end - 20), end) if marked[b:end] in score]))
        ids = codec.encode(text).tolist()
        plain = sum(vocabulary.scores[k] for k in ids if vocabulary.kinds[k] == "n")
        by_bytes = len(marked) - sum(len(vocabulary.pieces[k]) for k in ids if vocabulary.kinds[k] == "n")
        assert plain + by_bytes * codec.fallback == pytest.approx(best[-1])


def test_unigram_scores_are_kept():
    v = pieces.Vocabulary(["<unk>", "▁a", "b", "ab", *(f"<0x{b:02X}>" for b in range(256))], [0, -1.5, -2.5, -3.0, *[0] * 256], "cnnn" + "b" * 256)
    codec = pieces.Codec(v)
    assert codec.encode("ab b").tolist()[:2] == [1, 2] and codec.decode(codec.encode("ab b é").tolist()) == "ab b é"


def test_vocabularies_do_not_mix(spark, docs_of):
    base = [*(f"<0x{b:02X}>" for b in range(256))]
    one = pieces.Vocabulary([*base, "▁", "x", "ab"], [0.0] * 256 + [-1.0, -2.0, -2.0], "b" * 256 + "nnn")
    two = pieces.Vocabulary([*base, "▁", "y", "cd"], [0.0] * 256 + [-1.0, -2.0, -2.0], "b" * 256 + "nnn")
    rows = docs_of([(k, "ab cd") for k in range(8)]).select("doc_id", "text").repartition(2)
    for v in (one, two, one):  # workers are used again
        assert {tuple(r["ids"]) for r in pieces.encode_pieces(rows, v).collect()} == {tuple(pieces.Codec(v).encode("ab cd").tolist())}


def _brute(rows, queries, k):
    out = {}
    for q, x in queries.items():
        scored = sorted((-int(np.dot(x, y)), i) for i, y in rows if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_top_k_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(topk, "LEAF", 8)
    monkeypatch.setattr(topk, "SEED_ROWS", 40)
    x = rng.normal(0, 0.3, (600, 12))
    x[50:250] = x[50]  # ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(1000, None), (1020, [1.0, None, 0.0]), (1040, [float("nan")] * 12), (1060, [float("inf")] + [0.0] * 11), (None, [1.0] * 12), (1080, []), (1100, [2.0])]
    table = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>")
    grid = topk.grid_vectors(table)
    whole = [(r["vec_id"], np.array(list(r["v"]) + [0] * (12 - len(r["v"])))) for r in grid.collect()]
    assert {1080, 1100} <= {i for i, _ in whole} and not {1000, 1020, 1040, 1060, None} & {i for i, _ in whole}
    for block in (10_000, 7):
        found = {}
        for r in topk.top_k(grid, F.col("vec_id") % 20 == 0, 20, block).orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert found == _brute(whole, {i: v for i, v in whole if i % 20 == 0}, 20)


def test_top_k_of_few(spark):
    one = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id bigint, embedding array<float>")
    assert [(r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(topk.grid_vectors(one), F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1, 64 * 128), (2, 1, 64 * 128)]
    assert topk.top_k(topk.grid_vectors(one.limit(0)), F.col("vec_id") == 0).count() == 0
    assert topk._products(np.array([[2**62]]), np.array([[4]]))[0, 0] == 2**63 - 1


def test_top_k_with_repeated_ids_and_wide_scores(spark):
    rows = [(0, [3.0, 1.0]), (0, [1.0, 2.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (20, [1e30, -1e30]), (40, [1e30, 0.0]), (60, [1e30, 1.0]), (2, None)]
    grid = topk.grid_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    found = {}
    for r in topk.top_k(grid, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    top = 2**63 - 1
    # [1, 2] asks for id 0; what is beyond 64 bits stops there and ties by id
    assert found[0] == [(40, top), (60, top), (1, 2 * 64 * 64), (1, 2 * 64 * 64), (1, 64 * 64), (20, 1 - top)]
    assert found[40] == [(0, top), (0, top), (1, top), (20, top), (60, top), (1, 0), (1, 0)]


def _edited(text, edits, rng):
    s = list(text)
    for _ in range(edits):
        at = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[at] = "z"
        elif kind == 1:
            s.insert(at, "q")
        else:
            del s[at]
    return "".join(s)


def test_contamination_found_within_budget(spark, docs_of, words):
    rng = random.Random(8)
    items = [(k, " ".join(words(900 + k, rng.randrange(20, 60)))) for k in range(20)] + [(100, "tiny Q"), (101, ""), (102, None), (3, " ".join(words(903, 30)))]
    bench = spark.createDataFrame(items, "item_id int, text string")
    rows, wanted = [(1000, None), (1001, ""), (1002, "x" * 30_000), (1003, "has TINY\tq inside")], {(1003, 100)}
    for k in range(20):
        text = items[k][1]
        edits = decontaminate.budget(len(text))
        body = words(k, 400)
        rows.append((k, " ".join(body[:200]) + " " + _edited(text, edits, rng).upper().replace(" ", "\n") + " " + " ".join(body[200:])))
        wanted.add((k, k))
        rows.append((200 + k, " ".join(words(5000 + k, 300))))
        rows.append((400 + k, text[: len(text) // 2]))  # half an item is not the item
    rows += [(600, " ".join(words(1, 9000)) + items[0][1] + " ".join(words(2, 9000))), (601, items[1][1] + " " + items[1][1]), (601, items[1][1])]
    wanted |= {(600, 0), (601, 1)}
    docs = docs_of(rows)
    old, decontaminate.AT_ONCE = decontaminate.AT_ONCE, 5000
    try:
        found = decontaminate.contaminated(docs, bench).collect()
    finally:
        decontaminate.AT_ONCE = old
    assert {(r["doc_id"], r["item_id"]) for r in found} == wanted
    texts = dict(rows)
    for r in found:
        assert r["edits"] <= max(1, decontaminate.EDITS * (r["end"] - r["start"]) + 2) and 0 <= r["start"] < r["end"] <= len(texts[r["doc_id"]]) + 400
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in wanted}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(docs_of([]), bench).count() == 0


def _edit_distance(item, text):
    """Least edits of the item against any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_alignment_matches_full_table(words):
    rng = random.Random(3)
    for k in range(40):
        item = " ".join(words(k, 12))[:60]
        text = "xx " + _edited(item, k % 5, rng) + " yy"
        found = decontaminate.align(decontaminate.codes(item), decontaminate.codes(text), -20, 30, 60)
        assert found[0] == _edit_distance(item, text)


def test_filter_loses_no_occurrence(monkeypatch):
    """Index and brute force agree on which items occur, over few letters, so that q-grams repeat."""
    rng = random.Random(12)
    monkeypatch.setattr(decontaminate, "RUNS", 50)
    found = 0
    for _ in range(60):
        letters = rng.choice(["ab", "-", "-=", "abcd", "abcdefgh"])
        items = ["".join(rng.choice(letters) for _ in range(rng.randrange(8, 70))) for _ in range(4)]
        items.append((rng.choice(letters) + rng.choice(letters)) * 20)
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 200)))]
        for item in items:
            body = "".join(rng.choice(letters + "xyz") for _ in range(60))
            texts.append(body[:30] + _edited(item, rng.randrange(decontaminate.budget(len(item)) + 3), rng) + body[30:])
        index = decontaminate.Index(list(range(len(items))), [decontaminate.codes(x) for x in items])
        got = index.search(texts)
        wanted = {(r, k) for r, t in enumerate(texts) for k, x in enumerate(items) if _edit_distance(x, t) <= decontaminate.budget(len(x))}
        assert {(r, k) for r, k, *_ in got} == wanted
        found += len(wanted)
        for r, k, start, end, edits in got:
            assert _edit_distance(items[k], texts[r][start:end]) <= edits <= decontaminate.budget(len(items[k]))
        spans = {}
        for r, k, start, end, _ in got:
            assert all(end <= a or b <= start for a, b in spans.get((r, k), []))
            spans.setdefault((r, k), []).append((start, end))
    assert found > 200


def test_repetitive_long_texts_take_bounded_memory():
    import time
    import tracemalloc

    items = ["-" * 300, "-=" * 100, "a line -------------------- of marks " * 8]
    index = decontaminate.Index([0, 1, 2], [decontaminate.codes(x) for x in items])
    took = []
    for n in (250_000, 1_000_000):
        tracemalloc.start()
        began = time.time()
        found = index.search(["-" * n, "=-" * (n // 2)])
        took.append(time.time() - began)
        assert tracemalloc.get_traced_memory()[1] < 1e9
        tracemalloc.stop()
        assert sum(f[0] == 0 and f[1] == 0 for f in found) >= n // 330 and sum(f[0] == 1 and f[1] == 1 for f in found) >= n // 240
    assert took[1] < 120 and took[1] < 8 * took[0] + 5


def test_parts_of_the_benchmark_give_the_same(spark, docs_of, words, monkeypatch):
    items = [(k, " ".join(words(50 + k, 30))) for k in range(12)]
    bench, docs = spark.createDataFrame(items, "item_id int, text string"), docs_of([(k, t) for k, t in items])
    whole = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "PART_CHARS", 500)
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == whole and len(whole) == 12
    assert decontaminate.drop_contaminated(docs, bench).count() == 0


def test_pipeline_on_planted_corpus(spark, tmp_path, words):
    import corpus_pipeline

    rng, rows, labels = random.Random(5), [], []
    toxic, copies, leaks = set(), set(), set()
    bench = [(0, " ".join(words(70_000, 40)))]
    for k in range(240):
        own = words(80_000 + k, 120)
        if k % 4 == 0:
            for _ in range(6):
                own[rng.randrange(120)] = "vilescum" + rng.choice(["en", "ly"])
            toxic.add(k)
        text = " ".join(own)
        if k % 40 == 1:
            text += " " + bench[0][1]
            leaks.add(k)
        if k == 3:
            text += " write a@b.co"
        rows.append((k, text, "en", "s", len(text)))
        if k % 2 == 0 or k % 3 == 0:
            labels.append((k, 1, int(k in toxic)))
    for k in (5, 7, 9):
        own = rows[k][1].split()
        rows.append((1000 + k, " ".join(own[:50] + ["changed"] + own[51:]), "en", "s", 1))
        copies.add(1000 + k)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    got = {r["doc_id"]: r for r in found.collect()}
    clean = {r[0] for r in rows} - toxic - copies - leaks
    assert not set(got) & (leaks | copies) and len(set(got) & toxic) <= 3 and len(clean - set(got)) <= 3
    assert "[email]" in got[3]["text"] and got[3]["n_chars"] == len(got[3]["text"])
    codec = pieces.Codec(pieces.load())
    assert all(codec.decode(r["ids"]) == r["text"] for r in got.values())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


def test_pipeline_matches_brute_force(spark, tmp_path, words):
    """Every stage by plain loops: the same rows, texts and ids come out."""
    import re
    from itertools import combinations

    import corpus_pipeline
    from strandline.llm import simhash, toxicity

    rng, rows = random.Random(15), []
    bench = [(k, " ".join(words(91_000 + k, 25))) for k in range(3)]
    for k in range(150):
        own = words(92_000 + k, rng.randrange(20, 160))
        if k % 5 == 0:
            for _ in range(4):
                own[rng.randrange(len(own))] = "vilescum" + rng.choice(["en", "ly"])
        text = " ".join(own)
        if k % 20 == 3:
            text += " " + _edited(bench[k % 3][1], rng.randrange(3), rng) + " and more"
        if k % 7 == 1:
            text += " write bob%d@mail.example.org or 10.0.0.%d now" % (k, k)
        rows.append((k, text))
    for k in (2, 4, 6, 8, 9, 11, 12):  # copies of all degrees, also of copies
        own = rows[k][1].split()
        for j in range(6):
            own = list(own)
            own[rng.randrange(len(own))] = f"changed{j}"
            rows.append((1000 + 10 * k + j, " ".join(own)))
    rows += [(5, rows[5][1]), (None, rows[6][1]), (2000, None), (2001, ""), (2002, "two words"), (2003, "two words")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars int")
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(150)], "doc_id bigint, quality int, toxic int")
    for name, frame in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame(bench, "item_id bigint, text string"))):
        frame.write.parquet(str(tmp_path / f"{name}.parquet"))
    found = sorted((repr(r["doc_id"]), r["text"], tuple(r["ids"]), r["n_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    model = toxicity.train(docs, labels)
    left = [r for r in rows if model.scores([r[1]])[0] < toxicity.THRESHOLD]
    sets = {t: frozenset(simhash.shingles(t, 5)) for _, t in left}
    name = list(range(len(left)))
    for i, j in combinations(range(len(left)), 2):
        a, b = sets[left[i][1]], sets[left[j][1]]
        if a == b or len(a & b) >= 0.8 * len(a | b):
            name = [name[i] if x == name[j] else x for x in name]
    least = {g: min((d for (d, _), n in zip(left, name, strict=True) if n == g and d is not None), default=None) for g in set(name)}
    gone = {d for (d, _), n in zip(left, name, strict=True) if d is not None and d != least[n]}
    left = [r for r in left if r[0] not in gone]
    fold = lambda t: re.sub(r"\s", " ", (t or "").lower())
    left = [r for r in left if not any(_edit_distance(fold(b), fold(r[1])) <= decontaminate.budget(len(b)) for _, b in bench)]
    mask = lambda t: t and re.sub(r"[0-9]+(\.[0-9]+){3}", "[ip]", re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[email]", t))
    codec = pieces.Codec(pieces.load())
    wanted = sorted((repr(d), mask(t), tuple(codec.encode(mask(t)).tolist()), len(codec.encode(mask(t)))) for d, t in left)
    assert [f[:2] for f in found] == [w[:2] for w in wanted] and found == wanted
    assert 80 < len(found) < 130


def test_stages_on_edge_rows(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id bigint, text string, lang string, source string, n_chars int, extra string"
    rows = [(1, None, None, None, None, None), (2, "", "en", "s", 0, "x"), (3, "word " * 20_000, "en", "s", 1, "x"), (3, "word " * 20_000, "en", "s", 1, "y"), (None, "no id here", "en", "s", 1, "x"), (4, "z" * 60_000, "en", "s", 1, "x")]
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(None, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, str(tmp_path))
        got = sorted(repr(r["doc_id"]) for r in found.collect())
        wanted = [1, 3, 3, 4, None] if name == "simhash_near_dedup" else [1, 2, 3, 3, 4, None]
        assert got == sorted(map(repr, wanted)), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    docs.drop("extra").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 5
