"""Toxicity, quality and language: held-out accuracy, gradients, forward-backward, edge cases."""

import itertools
import random

import numpy as np
import pytest

from strandline.llm import language, quality, toxicity

BAD = ["idiotar", "scumar", "trashar"]
EDGE = [(1, None), (2, ""), (3, " \n\n "), (4, "x" * 60_000), (5, "word " * 30_000), (6, "\n" * 5000), (1, None), (None, "null id")]


def _toxic_rows(words, n, seed):
    rng, rows = random.Random(seed), []
    for k in range(n):
        own = words(seed * 10_000 + k, rng.randrange(20, 150))
        y = k % 3 == 0
        if y:
            for _ in range(max(1, len(own) // 25)):
                own[rng.randrange(len(own))] = rng.choice(BAD) + rng.choice(["th", "en", "st", "ly"])
        rows.append((" ".join(own), int(y)))
    return rows


def test_toxicity_learns_and_edges_are_scored(spark, docs_of, words):
    model = toxicity.fit(_toxic_rows(words, 450, 1), 1 / 3)
    rows = _toxic_rows(words, 200, 2)
    score = model.scores([t for t, _ in rows])
    assert np.mean((score >= toxicity.THRESHOLD) == np.array([y for _, y in rows])) > 0.93
    found = toxicity.score_toxicity(docs_of(EDGE), model).collect()
    assert len(found) == len(EDGE) and all(0 <= r["score"] <= 1 for r in found)
    # a score does not depend on the texts beside it
    assert np.allclose(model.scores([rows[0][0]]), score[:1], atol=1e-5)


def test_scores_match_a_plain_forward_pass(words):
    """Every window of a text on its own, one word and one gate after another."""
    model = toxicity.fit(_toxic_rows(words, 120, 4), 1 / 3)
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def run(xs, side):
        h, out = np.zeros(toxicity.HIDDEN), []
        for x in xs:
            a, r = x @ p[f"in_{side}"] + p[f"bias_{side}"], h @ p[f"rec_{side}"]
            n = toxicity.HIDDEN
            reset, keep = sigmoid(a[:n] + r[:n]), sigmoid(a[n : 2 * n] + r[n : 2 * n])
            new = np.tanh(a[2 * n :] + reset * r[2 * n :])
            h = keep * h + (1 - keep) * new
            out.append(h)
        return out

    def score(text):
        own, best = toxicity.words_of(text), -np.inf
        starts = [0] if len(own) <= toxicity.LENGTH else [*range(0, len(own) - toxicity.LENGTH, toxicity.STRIDE), len(own) - toxicity.LENGTH]
        for s in starts:
            xs = [model.embed([w])[0, :-1].astype(np.float64) for w in own[s : s + toxicity.LENGTH]]
            h = np.array([np.concatenate(pair) for pair in zip(run(xs, "f"), run(xs[::-1], "b")[::-1], strict=True)])
            e = np.array([np.tanh(v @ p["att"]) @ p["att_v"] for v in h])
            w = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
            best = max(best, (w @ h) @ p["out"] + p["out_b"][0])
        return sigmoid(model.slope * best + model.shift)

    texts = [t for t, _ in _toxic_rows(words, 12, 5)] + [None, "", "one", " ".join(words(9, 33)), " ".join(words(8, 200))]
    assert model.scores(texts) == pytest.approx([score(t) for t in texts], abs=1e-4)


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    p = toxicity._start(rng)
    words = toxicity.word_features([b"alpha", b"beta", b"gamma", b""])
    ids, y, drop = rng.integers(0, 4, (6, 5)), np.array([1, 0, 1, 0, 1], np.float32), np.ones(4, np.float32)
    p = {k: v.astype(np.float64) for k, v in p.items()}
    loss = lambda: float(np.mean(np.logaddexp(0, (v := toxicity._step(p, words, ids, y, drop)[0])) - y * v))
    _, g = toxicity._step(p, words, ids, y, drop)
    for name in p:
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        old = p[name][at]
        p[name][at] = old + 1e-2
        up = loss()
        p[name][at] = old - 1e-2
        down = loss()
        p[name][at] = old
        assert (up - down) / 2e-2 == pytest.approx(g[name][at], rel=0.05, abs=2e-4), name


def test_toxicity_windows_cover_and_overlap():
    for n in (1, 31, 32, 33, 48, 100, 1000):
        starts = toxicity.windows_of(n)
        covered = {i for s in starts for i in range(s, min(s + toxicity.LENGTH, n))}
        assert covered == set(range(n)) and all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:], strict=False))


def test_long_text_scores_like_one(words):
    model = toxicity.fit([], 0.1)
    model.slope = 1.0
    text = " ".join(words(5, 2000))
    whole = model.scores([text])
    toxicity.AT_ONCE, old = 500, toxicity.AT_ONCE
    try:
        assert model.scores([text])[0] == pytest.approx(whole[0], abs=0.05)
    finally:
        toxicity.AT_ONCE = old


def _quality_rows(words, n, seed):
    rng, rows = random.Random(seed), []
    for k in range(n):
        y = k % 3 != 0
        lines = []
        for j in range(rng.randrange(1, 9)):
            own = words(seed * 100_000 + k * 20 + j, rng.randrange(4, 14))
            lines.append(" ".join(own).capitalize() + "." if y or rng.random() < 0.3 else " ".join(w + rng.choice(["%%%", "***", "$$$"]) for w in own))
        if not y:
            lines.append(" | ".join(words(k, 8)))
        rows.append(("\n".join(lines), int(y)))
    return rows


def test_quality_learns_and_edges_are_scored(docs_of, words):
    model = quality.fit(_quality_rows(words, 300, 1), 2 / 3)
    rows = _quality_rows(words, 150, 2)
    score = model.scores([t for t, _ in rows])
    assert np.mean((score >= quality.THRESHOLD) == np.array([y for _, y in rows])) > 0.95
    found = quality.score_quality(docs_of(EDGE), model).collect()
    assert len(found) == len(EDGE) and all(0 <= r["score"] <= 1 for r in found)


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(3)
    counts, trans = np.array([4, 1, 3]), rng.normal(size=(2, 2))
    unary = rng.normal(size=8)
    forward, backward = quality._chain(unary, trans, counts)
    got, at = 1 / (1 + np.exp(-(forward + backward))), 0
    for n in counts:
        total, good = 0.0, np.zeros(n)
        for labels in itertools.product((0, 1), repeat=int(n)):
            weight = np.exp(sum(unary[at + i] * v for i, v in enumerate(labels)) + sum(trans[a, b] for a, b in zip(labels, labels[1:], strict=False)))
            total += weight
            good += weight * np.array(labels)
        assert np.allclose(got[at : at + n], good / total)
        at += n


def test_long_chains_are_cut_without_a_difference():
    rng = np.random.default_rng(5)
    counts = np.array([700, 1, 4, 300_000, 513, 512, 1024, 1025])
    unary, trans = rng.normal(size=counts.sum()) * 2, rng.normal(size=(2, 2))
    forward, backward = quality._chain(unary, trans, counts)
    old, quality.PIECE = quality.PIECE, 10**9
    try:
        whole = quality._chain(unary, trans, counts)
    finally:
        quality.PIECE = old
    assert np.allclose(forward, whole[0], atol=1e-9) and np.allclose(backward, whole[1], atol=1e-9)


def test_features_do_not_depend_on_blocks(words, monkeypatch):
    texts = [t for t, _ in _quality_rows(words, 40, 9)] + ["", None, "\n\n", "one\none\none\n"]
    whole = quality.line_features(texts)
    monkeypatch.setattr(quality, "LINES_AT_ONCE", 3)
    for a, b in zip(whole, quality.line_features(texts), strict=True):
        assert np.array_equal(a, b)
    monkeypatch.setattr(quality, "AT_ONCE", 40)
    assert np.array_equal(whole[0], quality.line_features(texts)[0])


def test_a_million_lines_take_bounded_memory(words):
    import time
    import tracemalloc

    model = quality.fit(_quality_rows(words, 60, 1), 2 / 3)
    for text in ("\n" * 1_000_000, "a line.\n" * 400_000):
        tracemalloc.start()
        began = time.time()
        score = model.scores([text])
        assert 0 <= score[0] <= 1 and time.time() - began < 60 and tracemalloc.get_traced_memory()[1] < 5e8
        tracemalloc.stop()


def test_quality_of_ties_and_clashing_columns(spark, docs_of, words):
    rows = [(k, t) for k, (t, _) in enumerate(_quality_rows(words, 60, 3))]
    rows += [rows[7], rows[7], (None, rows[7][1]), (900, None), (901, "")]
    labels = spark.createDataFrame([(k, int(k % 3 != 0), int(k % 3 == 0), "a", "b") for k in range(60)], "doc_id bigint, quality int, toxic int, y string, text string")
    for run in (quality.quality, toxicity.toxicity):
        found = run(docs_of(rows), labels)
        assert found.columns == ["doc_id", "held_out", "score", "predicted"]
        rows_of = {}
        for r in found.collect():
            rows_of.setdefault(r["doc_id"], []).append(r["score"])
        assert len(rows_of[7]) == 3 and np.ptp(rows_of[7]) < 1e-5 and abs(rows_of[None][0] - rows_of[7][0]) < 1e-5
        assert abs(rows_of[900][0] - rows_of[901][0]) < 1e-5


def test_classifiers_from_tables(spark, docs_of, words):
    rows = _quality_rows(words, 60, 3)
    docs = docs_of(list(enumerate(t for t, _ in rows)))
    labels = spark.createDataFrame([(i, y, 1 - y) for i, (_, y) in enumerate(rows)] + [(None, 1, 1), (3, None, None), (900, 1, 0)], "doc_id bigint, quality int, toxic int")
    for run, mod, rest in ((quality.quality, 5, 0), (toxicity.toxicity, 4, 2)):
        import zlib

        found = run(docs, labels).collect()
        assert len(found) == 60
        for r in found:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == rest) and r["predicted"] == int(r["score"] >= 0.3)
        nothing = run(docs_of([]), labels.limit(0))
        assert nothing.count() == 0
        assert run(docs, labels.limit(0)).count() == 60


LANGS = {"aa": ["bata", "goto", "luma", "sita"], "bb": ["krisp", "drong", "flent", "vorst"]}


def test_language_fuses_evidence(spark):
    rng = random.Random(6)
    say = lambda lang, n: " ".join(rng.choice(LANGS[lang]) for _ in range(n))
    model = language.fit([(lang, say(lang, 200)) for lang in LANGS for _ in range(5)])
    rows, wanted = [], {}
    for k in range(200):
        lang = "aa" if k % 2 else "bb"
        declared = lang if rng.random() < 0.9 else ("bb" if lang == "aa" else "aa")
        body = say(lang, 40) if k % 10 else ""  # no text: only the rest speaks
        rows.append((k, f"https://w{k % 6}.site-{lang}.{lang}/p", f'<html lang="{declared}"><script>{say("aa", 50)}</script><p>{body}&amp;</p>'))
        wanted[k] = lang
    rows += [(500, None, None), (501, "not a url", ""), (502, "http://[bad", "<html lang=aa"), (None, "", say("aa", 30)), (0, rows[0][1], rows[0][2])]
    found = language.page_languages(spark.createDataFrame(rows, "page_id bigint, url string, html string"), model).collect()
    assert len(found) == len(rows)
    right = [r["lang"] == wanted[r["page_id"]] for r in found if r["page_id"] in wanted]
    assert np.mean(right) == 1.0
    assert all(r["lang"] in LANGS and 0 < r["probability"] <= 1 for r in found)
    assert language.page_languages(spark.createDataFrame([], "page_id bigint, url string, html string"), model).count() == 0


def _posterior(pages, model):
    """Every page's posterior by a loop over all others."""
    seen = [(*language.address(u), language.declared_language(h), model.log_likelihoods(language.visible_text(h))) for _, u, h in pages]
    soft = [np.exp(ll - ll.max()) / np.exp(ll - ll.max()).sum() for *_, ll in seen]
    n, whole, out = len(model.languages), sum(soft), []
    for i, (host, domain, suffix, declared, ll) in enumerate(seen):
        others = lambda place, value, i=i: [soft[j] for j in range(len(seen)) if j != i and seen[j][place] == value]
        prior = base = (whole + 1) / (len(seen) + n)
        if host:
            for place, value in ((1, domain), (0, host)):
                held = others(place, value)
                prior = (sum(held, np.zeros(n)) + language.PRIOR_PAGES * prior) / (len(held) + language.PRIOR_PAGES)
        value = ll + np.log(prior)
        for place, key in ((3, declared), (2, suffix)):
            if key:
                held = others(place, key)
                value = value + np.log((sum(held, np.zeros(n)) + language.CELL * (len(held) + 1) / len(seen)) / (whole - soft[i] + language.CELL))
        out.append(np.exp(value - value.max()) / np.exp(value - value.max()).sum())
    return out


def test_language_matches_a_loop_over_all_pages(spark, monkeypatch):
    rng = random.Random(11)
    model = language.fit([(lang, " ".join(rng.choice(LANGS[lang]) for _ in range(50))) for lang in LANGS for _ in range(3)] + [("cc", "zorp quill")])
    urls = [None, "", "bad url", "http://a.x.aa", "http://b.x.aa/1", "http://y.co.bb", "http://z.y.co.bb", "http://w.v.co.bb", "http://q"]
    pages = []
    for k in range(120):
        lang = rng.choice(["aa", "bb"])
        body = " ".join(rng.choice(LANGS[lang]) for _ in range(rng.choice([0, 2, 9])))
        pages.append((k, rng.choice(urls), rng.choice([None, "", f"<html lang={rng.choice(['aa', 'bb', 'xx'])}>{body}", body, "<!--" + "-" * 7000 + f"--><html lang={lang}>{body}"])))
    pages += pages[:5] + [(None, None, "x" * 100_000)]
    frame = spark.createDataFrame([(*p, "a", "b", "c", "d") for p in pages], "page_id bigint, url string, html string, host string, ll string, p0 string, all_n string")
    found = language.page_languages(frame, model).collect()
    monkeypatch.setattr(language, "MOST_SUMS", 0)
    by_shuffle = language.page_languages(frame, model).collect()
    assert sorted((repr(r["page_id"]), r["lang"], round(r["probability"], 9)) for r in found) == sorted((repr(r["page_id"]), r["lang"], round(r["probability"], 9)) for r in by_shuffle)
    wanted = [(repr(p[0]), model.languages[int(np.argmax(q))], round(float(q.max()), 6)) for p, q in zip(pages, _posterior(pages, model), strict=True)]
    assert sorted((repr(r["page_id"]), r["lang"], round(r["probability"], 6)) for r in found) == sorted(wanted)


def test_pages_without_address_do_not_tell_of_each_other(spark):
    model = language.fit([("aa", "bata goto"), ("bb", "krisp drong")])
    pages = [(k, None, "krisp drong krisp drong krisp drong " * 20) for k in range(30)] + [(99, None, None)]
    found = {r["page_id"]: r for r in language.page_languages(spark.createDataFrame(pages, "page_id bigint, url string, html string"), model).collect()}
    base = (30 + 1) / (31 + 2)  # the table's own shares only
    assert found[99]["probability"] == pytest.approx(base, abs=0.03) and found[1]["lang"] == "bb"
    even = language.page_languages(spark.createDataFrame([(1, None, None), (2, "", "")], "page_id bigint, url string, html string"), model).collect()
    assert {(r["lang"], r["probability"]) for r in even} == {("aa", 0.5)}  # a tie


def test_language_parts():
    assert language.visible_text("a<!-- x --><style>b</style><b>c</b>&lt;<script>unclosed") == "a  \xa0c <".replace("\xa0", " ") or "unclosed" not in language.visible_text("a<script>unclosed")
    assert language.declared_language('<HTML class="x" lang=EN-us>') == "en" and language.declared_language(None) == ""
    assert language.address("https://a.b.co.uk:80/x") == ("a.b.co.uk", "b.co.uk", "uk") and language.address("http://x.y.com/") == ("x.y.com", "y.com", "com") and language.address("//co.uk") == ("co.uk", "co.uk", "uk") and language.address(None) == ("", "", "")


def test_language_training_from_table(spark):
    rows = [(i, say, lang) for i, (lang, say) in enumerate([("aa", "bata goto"), ("bb", "krisp drong"), (None, "x"), ("aa", None)])]
    model = language.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.languages == ["aa", "bb"] and model.log_likelihoods("krisp krisp")[1] > model.log_likelihoods("krisp krisp")[0]
    assert language.train(spark.createDataFrame([], "doc_id bigint, text string, lang string")).languages == ["und"]


def test_declared_language_after_a_long_start():
    for start in ("<!-- " + "licence <html lang=fr> " * 1000 + "-->", " \n" * 9000, "<script>x = '<html lang=fr>'" + ";" * 6000 + "</script>"):
        assert language.declared_language(start + "<!DOCTYPE html><html class=a lang='de-AT'><p>x") == "de"
    assert language.declared_language("<!-- <html lang=fr> ") == "" and language.declared_language(None) == ""
    assert language.declared_language("<html lang=e" * 200_000) == language.declared_language("<!--" * 200_000) == ""


def test_training_rows_are_the_least_hashes(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(k % 900, f"text {k % 900}" + " long" * (2000 if k % 50 == 0 else 1), "aa" if k % 3 else "bb") for k in range(1800)] + [(5, "text of five", "aa")] * 500
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = []
    monkeypatch.setattr(language, "fit", lambda found: got.extend(found))
    language.train(docs, per_language=7, most_chars=1000)
    ranked = docs.withColumn("low", F.xxhash64("doc_id")).withColumn("long", F.length("text") > 1000).orderBy("lang", "long", "low", "doc_id").collect()
    for lang in ("aa", "bb"):
        ids = list(dict.fromkeys(r["doc_id"] for r in ranked if r["lang"] == lang and not r["long"]))[:7]
        assert sorted(t for x, t in got if x == lang) == sorted(min(r["text"] for r in ranked if r["lang"] == lang and r["doc_id"] == d) for d in ids)


def test_every_language_is_trained(spark):
    rows = [(k, f"words of {k} " * 3, f"l{k:03d}") for k in range(120)]
    rows += [(1000 + k, "lange worte " * 2000, "zz") for k in range(3)]
    rows += [(2000 + k, "long " * 5000 if k < 5 else "short words", "yy") for k in range(8)]
    model = language.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), per_language=3)
    assert model.languages == sorted({lang for _, _, lang in rows})
    row = model.table[model.languages.index("zz")]
    assert row.max() > row.min()
    own = model.table[model.languages.index("yy")]
    assert own[language.gram_buckets("short words")].min() > own.min() >= own[language.gram_buckets("long")[2:3]].min()
