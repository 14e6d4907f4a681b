import hashlib
import random
import re

from strandline.llm import chat

SCHEMA = "conv_id bigint, turn int, role string, text string"


def test_reads_back_every_turn(spark):
    rng = random.Random(4)
    marks = ["\\", "<", ">", "###", "</turn>", "\n", " ", "a", "é", "😀", ": ", "\\h", "\\l", "\\b", "#", "### user: "]
    rows = [(1, 0, "system", None), (1, 1, "user", ""), (1, 1, "user", ""), (None, 0, "assistant", "x"), (2, None, None, "late"), (3, 0, "a: b", "t" * 9000), (4, 0, "system", "s" * 9000)]
    for c in range(10, 40):
        for t in range(rng.randrange(1, 30)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool:x"]), "".join(rng.choice(marks) * rng.randrange(1, 40) for _ in range(rng.randrange(6)))))
    windows = chat.format_chat(spark.createDataFrame(rows, SCHEMA), budget=300, history=60).cache()
    found = {r["conv_id"]: r for r in chat.chat_digest(windows).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert found.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        learned = "".join(x for _, r, x in turns if r == "assistant")
        r = found[c]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    system = {c: _tokens(t[0][2]) for c, t in by.items() if t[0][1] == "system"}
    for w in windows.collect():
        room = max(300 - system.get(w["conv_id"], 0), chat.ROOM)
        opens = w["window_id"] == 0 and w["conv_id"] in system
        own = system.get(w["conv_id"], 0) if opens or w["n_repeated"] else 0
        assert w["n_tokens"] - own <= room or w["n_turns"] - opens == 1
        assert w["n_repeated"] <= 5
        for piece in w["formatted"].split("</turn>\n")[:-1]:
            assert piece.startswith("### ") and not re.search("###|</turn>", piece[4:])


def _tokens(text):
    return len(re.findall("[^ \n\t\r]{1,4}", text)) + chat.MARKS


def test_budget_with_a_long_system_turn(spark):
    rows = []
    for c, long in enumerate((0, 100, 300, 380, 440, 453, 600)):
        rows += [(c, 0, "system", "word " * long)] + [(c, t, ["assistant", "user"][t % 2], "turn " * 30) for t in range(1, 40)]
    for w in chat.format_chat(spark.createDataFrame(rows, SCHEMA)).collect():
        long = (0, 100, 300, 380, 440, 453, 600)[w["conv_id"]] + chat.MARKS
        assert w["n_tokens"] <= max(512, long + chat.ROOM) and w["n_turns"] - (w["window_id"] == 0) <= 13


def test_many_turns_and_other_columns(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") % 2 + 1).cast("int")).alias("role"), F.concat(F.lit("## "), F.col("id").cast("string")).alias("text"))
    clash = rows.withColumns({c: F.lit("x") for c in ("pos", "tokens", "cost", "prefix", "uses", "u", "parts", "window_id", "opens", "allowed", "formatted", "loss", "bucket")})
    found = chat.chat_digest(chat.format_chat(clash)).first()
    learned = "".join(f"## {k}" for k in range(1, 20_000, 2))
    assert found["n_turns"] == 20_000 and found["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()


def test_windows_keep_system_and_history(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, t, ["assistant", "user"][t % 2], f"turn {t} " + "word " * 30) for t in range(1, 20)]
    windows = chat.format_chat(spark.createDataFrame(rows, SCHEMA), budget=240, history=80).orderBy("window_id").collect()
    assert len(windows) > 3 and sum(w["n_turns"] for w in windows) == 20
    for w in windows[1:]:
        assert w["formatted"].startswith("### system: be kind</turn>\n") and w["n_repeated"] >= 2
        for s in w["loss"]:
            assert w["formatted"][: s["start"]].endswith("### assistant: ") and w["formatted"][s["end"] :].startswith("</turn>\n")
    assert all(w["n_tokens"] <= 240 for w in windows)


def test_empty_table(spark):
    assert chat.chat_digest(chat.format_chat(spark.createDataFrame([], SCHEMA))).count() == 0
