"""Near copies, components, contamination and vectors: brute force and odd input."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from terrapyr.llm import embedding_dedup, simhash
from terrapyr.llm.components import components, forest
from terrapyr.llm.entry import QUERIES


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(n, pairs):
    at = list(range(n))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        at[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_simhash_query_against_brute_force(spark, sf_dir):
    rows = sorted((r["doc_id"], plain_fingerprint(r["text"])) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    fp = [f for _, f in rows]
    comp = classes(len(rows), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3])
    want = sorted((d, format(f, "016x"), rows[c][0]) for (d, f), c in zip(rows, comp))
    assert sorted(map(tuple, QUERIES["op5_simhash_dedup"](spark, sf_dir).collect())) == want


def test_links_connect_what_brute_force_links(spark, monkeypatch):
    """Clusters that crowd keys, with plain and blocked comparison."""
    r = random.Random(4)
    fps = {0, (1 << 64) - 1}
    for _ in range(6):
        base = r.getrandbits(64)
        for _ in range(60):
            x = base
            for b in r.sample(range(64), r.randrange(0, 5)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = classes(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    for crowded, block in ((10_000, 1024), (3, 7)):
        monkeypatch.setattr(simhash, "CROWDED", crowded)
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = {x["node"]: x["component"] for x in components(simhash.links(df)).collect()}
        assert all((got.get(signed[i], signed[i]) == got.get(signed[j], signed[j])) == (want[i] == want[j]) for i in range(len(fps)) for j in range(i))


def test_simhash_odd_input(spark):
    long = "word%d " * 1
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(5, None, "a"), (3, "", "b"), (4, " \t\n", "c"), (7, "One", "d"), (7, "One", "d"), (8, "one", "d"), (None, "one", "e"), (10, long, "f"), (11, long + " end", "g"), (None, "quite another text here", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.group(docs).collect()), key=str)
    f = lambda t: format(plain_fingerprint(t), "016x")
    assert got == sorted([(5, "0" * 16, 3), (3, "0" * 16, 3), (4, "0" * 16, 3), (7, f("one"), 7), (7, f("one"), 7), (8, f("one"), 7), (None, f("one"), 7), (10, f(long), 10), (11, f(long + " end"), 10), (None, f("quite another text here"), None)], key=str)
    assert sorted((str(r["doc_id"]) for r in simhash.dedup(docs).collect())) == ["10", "3", "7", "None"]
    assert simhash.dedup(docs).columns == docs.columns
    assert simhash.group(docs.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    r = random.Random(2)
    n = 400
    edges = [(i, i + 1) for i in range(0, 150)] + [(200, i) for i in range(201, 300)] + [(r.randrange(300, n), r.randrange(300, n)) for _ in range(60)]
    want = classes(n, edges)
    r.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {x["node"]: x["component"] for x in components(df, part_rows=20).collect()}
    assert all(got.get(i, i) == want[i] for i in range(n))
    assert components(df.limit(0)).count() == 0


def test_forest_keeps_components():
    r = np.random.default_rng(3)
    a, b = r.integers(0, 80, 60), r.integers(0, 80, 60)
    x, y = forest(a, b)
    assert classes(80, zip(a, b)) == classes(80, zip(x, y))
    assert len(x) == len(set(x.tolist()))


def vectors(seed=5, n=900):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 16))
    x[100:400] = x[0] + 0.05 * r.normal(size=(300, 16))
    x[400:420] = x[50]
    x[500:520] = x[60] + 0.25 * r.normal(size=(20, 16))
    return x.astype(np.float32), r.integers(0, 2, n)


def plain_links(x, label):
    u = embedding_dedup.unit(x.astype(float))
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    return near, classes(len(x), zip(*np.nonzero(near)))


def frame(spark, x, label):
    return spark.createDataFrame([(i, x[i].tolist(), int(label[i])) for i in range(len(x))], "vec_id long, embedding array<float>, label int")


def test_vector_links_against_brute_force(spark):
    """Small regions, split ones, groups of near copies in blocks, and everything in one region."""
    x, label = vectors()
    df = frame(spark, x, label)
    near, comp = plain_links(x, label)
    for options in ({"region_rows": 90, "spacing": 60, "max_centres": 4}, {"region_rows": 200, "spacing": 60}, {}):
        out = embedding_dedup.near_links(df, **options)
        got = {r["vec_id"]: r for r in out.collect()}
        assert len(got) == len(x)
        assert all(got[i]["n_links"] <= near[i].sum() for i in got)
        assert sum(r["n_links"] for r in got.values()) >= 0.98 * near.sum()
        assert np.mean([got[i]["component_id"] == comp[i] for i in got]) > 0.99
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert embedding_dedup.audit(df, out, part=10) >= 0.98


def test_vector_recall_at_the_limit_over_hundreds_of_centres(spark):
    """Lone pairs with a cosine just above the limit, in random directions: the hardest to bring together."""
    r = np.random.default_rng(12)
    x = embedding_dedup.unit(r.normal(size=(6000, 64)))
    for i in range(0, 1200, 2):
        away = r.normal(size=64)
        away -= (away @ x[i]) * x[i]
        c = r.uniform(0.931, 0.96)
        x[i + 1] = c * x[i] + (1 - c * c) ** 0.5 * away / np.linalg.norm(away)
    label = np.zeros(len(x), int)
    near, _ = plain_links(x.astype(np.float32), label)
    assert near.sum() >= 1190
    out = embedding_dedup.near_links(frame(spark, x.astype(np.float32), label), spacing=20, region_rows=400)
    got = {r["vec_id"]: r["n_links"] for r in out.collect()}
    assert all(got[i] <= near[i].sum() for i in got)
    assert sum(got.values()) >= 0.9 * near.sum()


def test_vector_recall_on_the_given_tables(spark):
    for sf in ("sf0.1", "check_s"):
        v = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        assert embedding_dedup.audit(v, embedding_dedup.near_links(v), part=20) >= 0.95


def test_pruned_graph_keeps_near_and_drops_hidden_neighbours():
    """Points on a circle: each keeps the next on both sides, and none behind them."""
    at = np.linspace(0, 1.2, 40)
    x = np.stack([np.cos(at), np.sin(at)], 1)
    a, b = embedding_dedup.robust_prune(x, 12, 1.2)
    kept = {(i, j) for i, j in zip(a.tolist(), b.tolist())}
    assert {(i, i + 1) for i in range(39)} | {(i + 1, i) for i in range(39)} <= kept
    assert not any(1 < abs(i - j) < 5 for i, j in kept)


def test_vector_odd_input(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [1.0, nan], 1), (8, [inf, 0.0], 1), (9, [1.0, 0.0], 2), (10, [1.0, 0.0, 0.0], 1), (11, [], 1), (12, [1.0, 0.0], 1), (12, [1.0, 0.0], 1), (13, [0.93, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cls", F.lit("x"))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_links(df).collect())
    linked = {1, 2, 12, 13}
    assert got == sorted((i, 4 if i in linked else 0, 1 if i in linked else i, i == 1 or i not in linked) for i, _, _ in rows)
    assert embedding_dedup.near_links(df.limit(0)).count() == 0
