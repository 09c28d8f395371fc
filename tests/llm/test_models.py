"""Classifiers by held-out accuracy, and the pipeline stage by stage."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrapyr.llm import decontaminate, mixing, quality, toxicity
from terrapyr.llm.common import arrow_bytes, fold_letters

from .test_near_copies import survivors

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_on_held_out_labels(spark, labelled):
    docs, labels = labelled
    got = quality.op10_quality_mil(spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 500
    assert (got.predicted == got.quality).mean() > 0.95
    assert got.score.between(0, 1).all()


def random_bags(r, sizes, width=5, buckets=8):
    out = []
    for n in sizes:
        many = r.integers(0, 4, n)
        out.append(quality.Bags(r.normal(size=(n, width)), np.array([0, n]), r.integers(0, buckets, many.sum()).astype(np.uint16), np.concatenate([[0], np.cumsum(many)])))
    return out


def test_quality_gradients_and_fit():
    r = np.random.default_rng(0)
    m = quality.AttentionMIL(5, hidden=4, gate=3, buckets=8)
    m.p["E"] = m.p["E"].astype(np.float64) * 10
    bags, y = random_bags(r, (1, 4, 3)), np.array([1.0, 0.0, 1.0])
    whole, weight = quality.Bags.join(bags), np.array([0.3, 0.5, 0.2])
    g = m.gradients(whole.x, whole, y, weight)
    for k, p in m.p.items():
        for at in list(np.ndindex(p.shape))[:12]:
            loss = []
            for d in (1e-5, -1e-5):
                p[at] += d
                out = m.score(whole)
                loss.append(-(weight * (y * np.log(out) + (1 - y) * np.log(1 - out))).sum())
                p[at] -= d
            assert abs((loss[0] - loss[1]) / 2e-5 - g[k][at]) < 1e-4
    before = np.abs(m.score(whole) - y).sum()
    m.fit(bags, y, epochs=200)
    assert np.abs(m.score(whole) - y).sum() < 0.1 < before


def test_passages_do_not_depend_on_neighbours():
    import pyarrow as pa

    texts = ["a b c " * 90, "", "Zürich !!! " * 3, "  \n x", None, "one two", "\n\n"]
    whole = quality.passages(*arrow_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        alone = quality.passages(*arrow_bytes(pa.array([t], pa.string())))
        a, b = whole.base[i], whole.base[i + 1]
        assert np.allclose(whole.x[a:b], alone.x, atol=1e-6)
        assert whole.bucket[whole.start[a] : whole.start[b]].tolist() == alone.bucket.tolist()


def plain_score(m, text):
    """A score by loops over words and passages, from the definitions."""
    raw = (text or "").encode()
    found = [(w.start(), w.end()) for w in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    groups = [found[i : i + 64] for i in range(0, len(found), 64)] or [[]]
    symbol = {c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-?()"}
    hidden, votes = [], []
    for k, g in enumerate(groups):
        x, seen, e = np.zeros(quality.WIDTH), set(), np.zeros(m.p["E"].shape[1])
        if g:
            body = raw[g[0][0] : groups[k + 1][0][0] if k + 1 < len(groups) else len(raw)]
            w = [raw[a:b].lower() for a, b in g]
            upper, digits = sum(65 <= c <= 90 for c in body), sum(48 <= c <= 57 for c in body)
            letters = sum(65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in body)
            n = len(g)
            x = np.array([upper / max(letters, 1), letters / len(body), digits / len(body), (sum(c in symbol for c in body) / len(body)) ** 0.5, (body.count(10) / len(body)) ** 0.5, n / 64, sum(map(len, w)) / n / 10, sum(p == q for p, q in zip(w, w[1:])) / n, len(set(w)) / n, sum(v[-1] in symbol for v in w) / n, sum(len(v) == 1 and v[0] in symbol for v in w) / n, sum(v[-1] in b".,;:?!" for v in w) / n])
            one = lambda v: int(quality.Spans(np.frombuffer(v, np.uint8)).hash(np.array([0]), np.array([len(v)]))[0])
            h = [one(v) for v in w]
            pair = lambda a, b: int(quality.mix(np.array([(a * int(quality._ODD) + b) % 2**64], np.uint64))[0])
            buckets = [v >> 52 for v in h] + [pair(a, b) >> 52 for a, b in zip(h, h[1:])]
            e = sum(m.p["E"][b].astype(float) for b in buckets) / len(buckets) ** 0.5
        v = np.tanh((x - m.mean) / m.scale @ m.p["W"] + e + m.p["b"])
        hidden.append(v)
        votes.append(float((np.tanh(v @ m.p["V"]) / (1 + np.exp(-(v @ m.p["U"])))) @ m.p["w"]))
    share = np.exp(np.array(votes) - max(votes))
    z = (share[:, None] * np.array(hidden)).sum(0) / share.sum()
    return 1 / (1 + math.exp(-(z @ m.p["c"] + m.p["d"][0])))


def test_scores_against_a_plain_forward_pass(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    m = quality.fit(docs, labels)
    assert m.constant is None
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n"), (-4, "one"), (-5, "ÄÖ 5% !!! " * 400)], "doc_id long, text string")
    texts = docs.select("doc_id", "text").union(odd)
    got = {r["doc_id"]: r["score"] for r in quality.score(texts, m).collect()}
    assert max(abs(got[r["doc_id"]] - plain_score(m, r["text"])) for r in texts.collect()) < 1e-4


def test_models_take_odd_input(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "word", "z"), (4, "w " * 50_000, "q"), (4, "w " * 50_000, "q")], "doc_id long, text string, score string")
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    same = spark.createDataFrame([(2, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, same)).collect()} <= {0.5, 1.0}
    assert {r["p_toxic"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    assert {r["p_toxic"] for r in toxicity.score(docs, toxicity.fit(docs, same)).collect()} == {1.0}
    assert toxicity.score(docs, toxicity.fit(docs, same), ["text", "score"]).columns == ["text", "score", "p_junk", "p_toxic_junk", "p_toxic"]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), same)).count() == 0
    mixed = spark.createDataFrame([(2, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.accept(docs, quality.fit(docs, mixed)).columns == docs.columns
    assert toxicity.accept(docs, toxicity.fit(docs, mixed)).count() <= 5
    assert quality.score(docs.limit(0), quality.fit(docs, mixed)).count() == 0
    assert quality.fit(docs.limit(0), mixed.limit(0)).constant == 0.5


def test_toxicity_on_unseen_labels(spark, labelled):
    docs, labels = labelled
    seen = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    rest = labels.join(seen, "doc_id", "left_anti")
    got = toxicity.score(docs, toxicity.fit(docs, seen)).join(rest, "doc_id").toPandas()
    hit = got.p_toxic >= 0.5
    assert hit[got.toxic == 1].mean() > 0.85
    assert hit[got.toxic == 0].mean() < 0.01


def plain_features(text):
    """Words and their prefixes, each with its count."""
    out = Counter()
    for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").lower().encode()):
        out[w, 0] += 1
        for n in toxicity.PREFIXES:
            if len(w) > n:
                out[w[:n], n] += 1
    return out


def plain_choice(rows, y, keep=512):
    """The features with the largest log-odds in these rows."""
    total, seen = [sum(v == 0 for v in y), sum(v == 1 for v in y)], [Counter(), Counter()]
    for r, v in zip(rows, y):
        seen[v].update(set(r))
    if not all(total):
        return []
    least, rank = 3 if total[1] >= 60 else 2, {}
    for f, n in seen[1].items():
        odds = math.log((n + 0.25) / (total[1] + 0.5)) - math.log((seen[0][f] + 0.25) / (total[0] + 0.5))
        if n >= least and odds > 1.5:
            rank[f] = odds * math.sqrt(min(n, 50))
    assert len(rank) <= keep
    return sorted(rank)


def plain_logistic(x, y, l2=2e-4):
    """The same objective, by Newton's method."""
    z = np.concatenate([x, np.ones((len(x), 1))], 1)
    weight, w = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y), np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-(z @ w)))
        w -= np.linalg.solve((z.T * (weight * p * (1 - p))) @ z + l2 * np.eye(len(w)), z.T @ (weight * (p - y)) + l2 * w)
    return lambda x: 1 / (1 + np.exp(-(np.concatenate([x, np.ones((len(x), 1))], 1) @ w)))


def plain_chain(train, test, fold_of, ys):
    """Probabilities for test rows; every model, that of a fold too, chooses its features from its own rows."""
    seen, asked = np.zeros((len(train), 0)), np.zeros((len(test), 0))
    dense = lambda rows, f: np.array([[math.log1p(r[x]) for x in f] for r in rows]).reshape(len(rows), -1)

    def model(k, use):
        y = np.array([ys[i][k] for i in use])
        if y.min() == y.max():
            return lambda rows, before: np.full(len(rows), float(y[0]))
        f = plain_choice([train[i] for i in use], y.tolist())
        m = plain_logistic(np.concatenate([dense([train[i] for i in use], f), seen[use]], 1), y)
        return lambda rows, before: m(np.concatenate([dense(rows, f), before], 1))

    for k in range(len(ys[0])):
        everything = model(k, list(range(len(train))))
        unseen = np.zeros(len(train))
        for fold in range(toxicity.FOLDS):
            mine = [i for i in range(len(train)) if fold_of[i] == fold]
            if mine:
                unseen[mine] = model(k, [i for i in range(len(train)) if fold_of[i] != fold])([train[i] for i in mine], seen[mine])
        asked, seen = np.concatenate([asked, everything(test, asked)[:, None]], 1), np.concatenate([seen, unseen[:, None]], 1)
    return asked


def test_chain_against_a_plain_one(spark, monkeypatch):
    """Two marks that overlap but are no functions of each other; words tell of them with noise."""
    r = random.Random(5)
    rows, marks = [], []
    for i in range(240):
        a, b = r.random() < 0.35, r.random() < 0.3
        w = [f"plain{r.randrange(12)}" for _ in range(r.randrange(3, 12))]
        w += ["Nasty", "nastier"][: r.randrange(3)] if a and r.random() < 0.9 else []
        w += [r.choice(["vile", "vilest!"])] if (a and b) or r.random() < 0.05 else []
        r.shuffle(w)
        rows.append((i, " ".join(w)))
        marks.append((i, int(a), int(a and b or r.random() < 0.05)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, rude int, toxic int").where("doc_id < 200")
    fold = {x["doc_id"]: x["f"] for x in docs.select("doc_id", F.pmod(F.xxhash64(F.lit(23), "doc_id", "text"), F.lit(toxicity.FOLDS)).alias("f")).collect()}
    fit, many = toxicity.Logistic.fit, []
    monkeypatch.setattr(toxicity.Logistic, "fit", lambda self, x, y, steps=20_000: (many.append(len(y)), fit(self, x, y, steps))[1])
    chain = toxicity.fit(docs, labels, {"rude": "rude = 1", "toxic": "toxic = 1"})
    assert len(many) == 2 + toxicity.FOLDS
    got = {x["doc_id"]: (x["p_rude"], x["p_toxic"]) for x in toxicity.score(docs, chain).collect()}
    features = [plain_features(t) for _, t in rows]
    want = plain_chain(features[:200], features, [fold[i] for i in range(200)], [m[1:] for m in marks[:200]])
    assert np.abs(np.array([got[i] for i in range(240)]) - want).max() < 0.02


def test_letters_fold():
    t = "ÀÉÞ×ß ΑΠΩ АПРЯ aZ ÿ"
    assert fold_letters(np.frombuffer(t.encode(), np.uint8)).tobytes().decode() == t.lower()


def test_pipeline_stages_against_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [s[0] for s in corpus_pipeline.STAGES]
    assert len(names) == 5
    now, ids = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf_dir)
        assert out.columns == docs.columns
        ids[name] = ({r[0] for r in now.select("doc_id").collect()}, {r[0] for r in out.select("doc_id").collect()})
        now = spark.createDataFrame(out.collect(), docs.schema)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    given, kept = ids[names[0]]
    assert len(bad & kept) <= 0.15 * len(bad) and len(given - kept) < 0.3 * len(given)
    given, kept = ids[names[2]]
    assert kept == set(survivors([(r["doc_id"], r["text"]) for r in docs.where(F.col("doc_id").isin(list(given))).collect()]))
    given, kept = ids[names[3]]
    found = {r["_id"] for r in decontaminate.find(docs.where(F.col("doc_id").isin(list(given))), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert kept == given - found
    last = {tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).collect()}
    assert last == {tuple(r) for r in mixing.mix(now).collect()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()} == last


def test_pipeline_odd_input(spark, sf_dir):
    """Nulls, empty and very long texts, repeated rows, columns that clash, and empty tables, through every stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(10**9 + i, t, "en", s, 0) for i, (t, s) in enumerate([(None, None), ("", "x"), (" \n", None), ("word " * 40_000, "x"), ("some short text of seven words", "x"), ("some short text of seven words", "x")])] + [(None, "a text without an id that is long enough", "en", "y", 0)] * 2
    more = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars int").select("doc_id", "text", "lang", "source", F.col("n_chars").cast(docs.schema["n_chars"].dataType)))
    clash = {c: F.lit(k) for k, c in enumerate(("score", "label", "_id", "_h", "h", "fp", "y", "hash", "pos", "component", "size"))}
    more = more.withColumns(clash)
    for given in (more, more.limit(0)):
        now = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, sf_dir)
            assert out.columns == given.columns
            now = spark.createDataFrame(out.collect(), given.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).count() == now.count()
        if given is more:
            assert now.count() > 0 and now.where("text is null or trim(text) = ''").count() <= 1
