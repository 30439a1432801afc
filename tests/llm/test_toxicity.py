import zlib

import numpy as np
import pytest

from dropletry.llm import op02_toxicity, toxicity


def test_learns_stems_and_leaves_clean_texts():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    texts, labels = [], []
    for k in range(600):
        t = list(rng.choice(words, 40))
        if k % 5 == 0:
            t[7] = "zzfoul" + str(rng.choice(words))
        texts.append(" ".join(t))
        labels.append(float(k % 5 == 0))
    m = toxicity.fit(texts[:400], np.array(labels[:400]), np.ones(400), toxicity.Settings())
    assert (((m.scores(texts[400:]) >= 0.7) == np.array(labels[400:])).mean()) > 0.98


def test_edges():
    none = toxicity.fit([], np.array([]), np.array([]), toxicity.Settings())
    assert none.scores(["a", None, ""]).max() < 1e-6
    one = toxicity.fit(["a b c"], np.array([1.0]), np.ones(1), toxicity.Settings())
    assert one.scores(["x"])[0] > 0.999


def test_features_and_ratios_against_sets():
    """The distinct n-grams by plain sets, each bucket's ratio by its formula."""
    s = toxicity.Settings(grams=(4, 5), bits=30, certain=0.0)  # as good as no two n-grams share a bucket
    hashed = toxicity.Hasher(toxicity.Settings(grams=(4, 5), bits=22))

    def grams(t):
        raw = f" {t} ".encode().lower() if t else b""
        return {raw[i : i + n] for n in s.grams for i in range(len(raw) - n + 1)}

    texts = ["Some bad text", "some good text", "", None, "BAD bad bad", "x" * 5000]
    assert all(len(hashed(t)) == len(grams(t)) for t in texts)
    assert set(hashed("Some Bad")) == set(hashed("sOME bAD")) < set(hashed("Some Bad text")) | set(hashed("Some Bad"))
    seen, docs = np.array([[3.0, 0.0], [1.0, 4.0]]), np.array([10, 5])
    got = toxicity.ratios(seen, docs, toxicity.Settings(certain=0.0))
    assert np.allclose(got, [np.log(2 / 7) - np.log(4 / 12), np.log(5 / 7) - np.log(1 / 12)])
    assert toxicity.ratios(seen, docs, toxicity.Settings(certain=1.5)).tolist()[0] == 0


def test_training_on_lists_equals_training_on_texts(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(80)]
    rows = [(k, " ".join(rng.choice(words, 30)) + (" zzfoul" if k % 4 == 0 else "")) for k in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(160)], "doc_id long, toxic int")
    m = toxicity.train(docs, labels)
    texts, y = [t for _, t in rows], np.array([float(k % 4 == 0) for k in range(160)])
    plain = toxicity.fit(texts, y, np.ones(160), toxicity.Settings())
    assert (plain.weights != 0).tolist() == (m.weights != 0).tolist()
    assert np.array_equal(m.scores(texts) >= 0.7, plain.scores(texts) >= 0.7) and np.array_equal(m.scores(texts) >= 0.7, y == 1)


def test_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "some text here", 9.0), (1, "some text here", 9.0), (2, None, 9.0), (3, "", 9.0), (None, "other", 9.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (4, 7)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert rows[0]["score"] == rows[1]["score"] and rows[2]["score"] == rows[3]["score"]
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels.limit(0))).count() == 0


def test_query_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op02_toxicity.query(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(p and not t for p, t in held) == 0 and sum(p == t for p, t in held) / len(held) > 0.93


def test_an_id_that_many_rows_share_is_bounded(spark, monkeypatch):
    seen = []
    plain = toxicity.descend
    monkeypatch.setattr(toxicity, "descend", lambda rows, ratio, labels, weights, s: seen.append((len(rows), labels, weights)) or plain(rows, ratio, labels, weights, s))
    docs = spark.createDataFrame([(1, f"bad words number {k}") for k in range(300)] + [(k, f"good words number {k}") for k in range(2, 12)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] + [(k, 0) for k in range(2, 12)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, toxicity.Settings(per_class=50))
    (n, marks, weights), = seen
    assert n == 60 and marks.sum() == 50 and weights[marks == 1].sum() == pytest.approx(300) and weights[marks == 0].sum() == pytest.approx(10)
    low, high = model.scores(["good words number 3", "bad words number 7"])
    assert low < 0.5 < high
