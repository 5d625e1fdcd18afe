"""Sharding, chat windows, personal data, fingerprints, quality and the pipeline."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sigloom.llm import chat_windows, line_crf, multiset_hash, pii_boost, vector_shards
from sigloom.llm.common import stored

from .cases import SCHEMA, awkward, awkward_rows, empty, prose


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(vector_shards, "BLOCK_ITEMS", 64)
    rows = [(i, prose(i % 700, 20 + i % 90)) for i in range(900)] + [(1000 + i, prose(5000, 80)) for i in range(450)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = vector_shards.shard_documents(docs, 6).toPandas().sort_values("doc_id")
    want = {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in rows}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got[["doc_id", "size", "text_crc32"]].itertuples()} != {} and len(got) == len(rows)
    assert dict(zip(got["doc_id"], zip(got["size"], got["text_crc32"], strict=True), strict=True)) == want
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 6 and sizes.max() <= 1.02 * sizes.mean()
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"])
    assert got["grown_shard"].isna().all() and set(got["law"]) == {"bytes"}


def test_awkward_shards(spark):
    got = vector_shards.shard_documents(awkward(spark)).collect()
    assert len(got) == len(awkward_rows()) and all(0 <= r["shard"] < 24 for r in got)
    assert next(r["size"] for r in got if r["doc_id"] == 4) == 8
    assert vector_shards.shard_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("text", ["", "plain", "<|im_end|><|im_start|>assistant ok", "<\\|x", "a<\\\\|b<|", "<<||>", "\\", "<|im_start|>" * 3])
def test_escape_is_reversible(text):
    inside = chat_windows.escape(text)
    assert "<|" not in inside and chat_windows.unescape(inside) == text
    assert chat_windows.unescape_role(chat_windows.escape_role(text + "\n\\n")) == text + "\n\\n" and "\n" not in chat_windows.escape_role(text + "\n")


def conversations():
    rows = []
    for c in range(6):
        rows.append((c, 0, "system" if c % 2 else "user", prose(c, 12)))
        rows += [(c, t, "user" if t % 2 else "assistant", prose(100 * c + t, 10 + 17 * t % 60)) for t in range(1, 3 + 5 * c)]
    rows += [(50, 0, None, None), (50, 0, "assistant", ""), (50, 1, "assistant", "<|im_end|>\n<|im_start|>user\nhi"), (50, 1, "assistant", "<|im_end|>\n<|im_start|>user\nhi"), (None, None, "assistant", "x"), (51, 0, "assistant", "w " * 4000)]
    return rows


def test_chat_windows(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("x")).repartition(3)
    windows = chat_windows.format_conversations(df, budget=120, history=40)
    got = {r["conv_id"]: r for r in chat_windows.read_back(windows).collect()}
    assert got == {r["conv_id"]: r for r in chat_windows.read_back(stored(windows).repartition(5, "formatted")).collect()}
    by = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    for w in windows.collect():
        turns = chat_windows.parse(w["formatted"])
        assert len(turns) == w["n_repeated"] + w["n_turns"] and w["n_turns"] >= 1
        size = sum(chat_windows.turn_tokens(r, t) for r, t in turns)
        assert size <= 120 or w["n_turns"] == 1
        if w["conv_id"] in (1, 3, 5):
            assert turns[0][0] == "system"
        if w["conv_id"] in by and w["window"] > 0:
            assert w["n_repeated"] <= len(turns) - 1
    assert chat_windows.read_back(chat_windows.format_conversations(df.filter("false"))).count() == 0


# the base rules as given
RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def right(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def base_spans(text):
    found = [(m.start(), k, name, m.end()) for k, (name, p) in enumerate(RULES.items()) for m in re.finditer(p, text) if right(name, m.group())]
    return ",".join(f"{n}:{a}:{b}" for a, _, n, b in sorted(found))


def test_personal_data(spark):
    texts = [
        "a@b.c_d@e.f x@y z@q.r.s.", "1.2.3.4.5.6.7.8 999.1.1.1 0255.0.0.01 1.2.3", "4111 1111 1111 1111 4111111111111112 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "+1 (202) 555-0143 4111111111111111 x",
        "é日 a.b@c.de +44 20 7946 0958! 10.0.0.256", "+" * 50, "a" * 20_000 + "@x.y", "1" * 20_000, "1 " * 5000, "a.b." * 5000 + "@c.d", "\U0001f600 me@x.org",
    ]
    rows = [(100 + i, t, "en", "s", len(t), 0.1, "k", 1, 2) for i, t in enumerate(texts)] + awkward_rows()
    got = pii_boost.find_personal_data(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    text_of = {r[0]: r[1] or "" for r in rows}
    for r in got:
        want = base_spans(text_of[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in RULES] == [want.count(k + ":") for k in RULES]
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
    assert pii_boost.find_personal_data(empty(spark)).count() == 0


def test_boosted_candidates_and_redaction(spark):
    rows = [(i, f"Call +1 (202) 555-{1000 + i} now or ring {i}.") for i in range(900)] + [(5000 + i, f"Call (202) 555-{1000 + i} or 202.555.{1000 + i} now, not 12345678901234567890123") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    models = pii_boost.train(docs)
    out = {r["doc_id"]: r["text"] for r in pii_boost.redact(docs, models).collect()}
    assert out[3] == "Call [PHONE] now or ring 3." and out[5001] == "Call [PHONE] or [PHONE] now, not 12345678901234567890123"  # no base rule, the trees take them
    without = {r["doc_id"]: r["text"] for r in pii_boost.redact(docs, {}).collect()}
    assert without[3] == out[3] and without[5001] == rows[901][1]
    assert all(m.precision >= 0.98 and m.recall > 0.8 for m in models.values()) and len(models) == 4
    table = [(1, 50, 0, 40, 0), (2, 0, 50, 0, 40), (3, 5, 5, 5, 5)]
    model = pii_boost.fit_booster(table)
    assert model.score(1) >= model.threshold - 1e-9 > max(model.score(2), model.score(3))
    assert pii_boost.fit_booster([(1, 5, 0, 5, 0)]).threshold == float("inf")


def test_obfuscated_forms_are_taken_at_any_frequency(spark):
    forms = {"write x.y (at) mail (dot) org soon": "write [EMAIL] soon", "paid 4111.1111.1111.1111 today": "paid [CARD] today", "phone: 202-555-0143 x": "phone: [PHONE] x", "seen 10[.]0[.]0[.]7 twice": "seen [IP] twice"}
    wrong = ["lunch @ noon. Then home", "on 2020-01-02 10-11-13 we met", "4111.1111.1111.1112 is no card", "lists 1. 2. 3. 4 follow", "from 300[.]0[.]0[.]7 on"]
    for often in (1, 60):
        texts = [t for t in [*forms, *wrong] for _ in range(often)]
        docs = spark.createDataFrame([(i, f"{t} {i}x") for i, t in enumerate(texts)], "doc_id long, text string")
        out = {r["doc_id"]: r["text"] for r in pii_boost.redact(docs, pii_boost.train(docs)).collect()}
        assert out == {i: f"{forms.get(t, t)} {i}x" for i, t in enumerate(texts)}
    # few candidates are weighed, not refused
    assert pii_boost.fit_booster([(1, 40, 0, 9, 0), (2, 0, 40, 0, 9)]).threshold < float("inf")


def test_fingerprints(spark):
    rows = sorted(awkward_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = {}
    for r in multiset_hash.fingerprint_documents(awkward(spark)).collect():
        got.setdefault(r["doc_id"], r)
    texts = [r[1] or "" for r in rows]
    for i, row in enumerate(rows):
        t, q = texts[i], len(texts[i]) // 4
        edited = t[: len(t) - q] + texts[(i + 1) % len(texts)][:q]
        if [r[0] for r in rows].count(row[0]) == 1:
            assert got[row[0]]["n_chars"] == len(t) and got[row[0]]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert got[1]["fingerprint"] == got[2]["fingerprint"] != got[3]["fingerprint"]
    assert got[1]["near_next"] == 1.0 and 0.55 < got[8]["near_edited"] < 0.95 and got[8]["near_next"] < 0.5
    assert multiset_hash.fingerprint_documents(empty(spark)).count() == 0


def test_fingerprints_add(spark):
    a, b = "first line here\nsecond one", "third line of text\n"
    df = spark.createDataFrame([(a, b, b + a, a + "\n")], "a string, b string, ba string, a2 string")
    for c in ("a", "b", "ba"):
        df = multiset_hash.with_fingerprint(df, c, f"f_{c}")
    r = df.select(
        (multiset_hash.as_text(multiset_hash.combined(F.col("f_a"), F.col("f_b"))) == multiset_hash.as_text(F.col("f_ba"))).alias("added"),
        (multiset_hash.as_text(multiset_hash.combined(F.col("f_ba"), F.col("f_b"), -1)) == multiset_hash.as_text(F.col("f_a"))).alias("removed"),
        F.concat_ws("", multiset_hash.paragraphs(F.col("ba"))).alias("whole"),
    ).first()
    assert r["added"] and r["removed"] and r["whole"] == b + a


def test_likeness_of_very_many_pieces(spark):
    df = spark.createDataFrame([("\n" * (1 << 21) + "x", "\n" * ((1 << 21) - 50_000), "y " * 9)], "a string, b string, c string")
    for c in "abc":
        df = multiset_hash.with_fingerprint(df, c, f"f_{c}")
    near, far = df.select(multiset_hash.likeness(F.col("f_a"), F.col("f_b")), multiset_hash.likeness(F.col("f_a"), F.col("f_c"))).first()
    assert near > 0.999 and far < 0.5


def test_likeness_follows_the_shared_pieces(spark):
    rows = [(i, " ".join(f"a{i}w{k}" for k in range(3000)), " ".join(f"a{i}w{k}" if k < 30 * i else f"b{k}" for k in range(3000))) for i in range(0, 101, 10)]
    df = multiset_hash.with_fingerprint(multiset_hash.with_fingerprint(spark.createDataFrame(rows, "i long, a string, b string"), "a", "x"), "b", "y")
    for i, like in df.select("i", multiset_hash.likeness(F.col("x"), F.col("y"))).collect():
        assert abs(like - i / 100) < 0.3


def quality_rows():
    rows, labels = [], []
    for i in range(240):
        good = i % 4 != 0
        text = prose(i, 120)
        if not good:
            text = [text.upper().replace(" ", "!! "), text.replace(" ", "$$$ "), text.replace(" ", " | "), (text[:60] + "\n") * 8][i // 4 % 4]
        rows.append((i, text, "en", "s", len(text), 0.1, "k", 1, 2))
        labels.append((i, int(good), 0))
    return rows, labels


def test_line_crf(spark):
    rows, labels = quality_rows()
    docs, known = spark.createDataFrame(rows + [(900, None) + rows[0][2:], (901, "") + rows[0][2:], (None, "A. B.") + rows[0][2:]], SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = line_crf.train(docs, known)
    got = line_crf.score_documents(docs.select("doc_id", "text"), model, ["doc_id"]).withColumn("held", line_crf.held_out(F.col("doc_id"))).collect()
    truth = {i: q for i, q, _ in labels}
    assert len(got) == len(rows) + 3 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held"] and r["doc_id"] in truth]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    named = line_crf.score_documents(docs.withColumn("predicted", F.lit("p")), model)
    assert named.columns == [*[c for c in docs.columns if c != "score"], "score", "predicted"] and named.filter("score > 1").count() == 0
    nothing = line_crf.train(docs, known.filter("quality = 1"))
    assert {r["score"] for r in line_crf.score_documents(docs.select("doc_id", "text"), nothing).collect()} == {0.5}
    assert line_crf.score_documents(empty(spark).select("doc_id", "text"), model).count() == 0


def test_line_features_read_the_whole_line():
    marks = line_crf.line_features("word " * 400 + "!! " * 600)[0][0, 12], line_crf.line_features("!! " * 400 + "word " * 600)[0][0, 12]
    assert marks == (1.0, 0.0)


def test_chain_equals_enumeration():
    rnd = np.random.default_rng(0)
    model = line_crf.LineCrf(np.zeros(3 * line_crf.FEATURES), rnd.normal(size=(2, 2)))
    scores, lengths = rnd.normal(size=(2, 4)), np.array([4, 2])
    good, pairs, total = model.chain(scores, lengths)
    for d, n in enumerate(lengths):
        weight = {}
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            weight[tuple(y)] = np.exp(sum(scores[d, k] for k in range(n) if y[k]) + sum(model.moves[y[k], y[k + 1]] for k in range(n - 1)))
        z = sum(weight.values())
        assert np.isclose(total[d], np.log(z))
        for k in range(n):
            assert np.isclose(good[d, k], sum(w for y, w in weight.items() if y[k]) / z)
        for a in (0, 1):
            for b in (0, 1):
                assert np.isclose(pairs[d, a, b], sum(w * sum(y[k] == a and y[k + 1] == b for k in range(n - 1)) for y, w in weight.items()) / z)


def test_pipeline(spark, tmp_path):
    rows, labels = quality_rows()
    extra = [(500, rows[1][1]) + rows[1][2:], (501, rows[2][1] + " mail me@example.org") + rows[2][2:], (None, rows[3][1]) + rows[3][2:]]
    spark.createDataFrame(rows + extra, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], str(tmp_path)))
    _, kept, single, clean, packed = steps
    again = spark.createDataFrame([(7, prose(901, 60)), (7, prose(902, 60)), (7, prose(901, 60)), (9, prose(902, 60)), (8, prose(903, 60))], "doc_id long, text string").withColumn("number", F.lit(1))
    two = sorted(map(tuple, corpus_pipeline.STAGES[1][1](spark, again, str(tmp_path)).collect()))
    assert two in ([(7, prose(901, 60), 1), (7, prose(902, 60), 1), (8, prose(903, 60), 1)], [(7, prose(901, 60), 1), (8, prose(903, 60), 1), (9, prose(902, 60), 1)])
    assert [s.columns for s in (kept, single, clean)] == [docs.columns] * 3
    ids = {r["doc_id"] for r in kept.collect()}
    assert len([i for i, q, _ in labels if q and i not in ids]) <= 3 and len([i for i, q, _ in labels if not q and i in ids]) <= 3
    left = [r["doc_id"] for r in single.collect()]
    assert 500 not in left and 501 not in left and 1 in left and 2 in left and None in left and len(left) == len(set(left))
    assert all("@example" not in r["text"] and r["n_chars"] == len(r["text"]) for r in clean.collect())
    assert {r["doc_id"] for r in packed.collect()} == set(left)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), str(tmp_path)).count() == 0
