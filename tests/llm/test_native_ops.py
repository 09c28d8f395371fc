"""URL filters and mixing: brute force and odd input."""

import re
from collections import defaultdict

import numpy as np
import xxhash

from terrapyr.llm import mixing, url_filter
from terrapyr.llm.entry import QUERIES

URLS = "page_id long, url string, html string, host string"


def test_url_odd_input(spark):
    rows = [(1, None, None, "x"), (2, "", "", None), (3, "no scheme", "", ""), (4, "HTTP://A.Example.ORG/es/a?b#c", "", ""), (5, "http://example.org/es", "", ""), (6, "http://badexample.org/es/", "", ""), (7, "http://org/", "", ""), (7, "http://org/", "", ""), (8, "http://x.com", "", ""), (9, "x://a.com?/fr/", "", ""), (None, "http://b.com/de/" + "p" * 50_000, "", "")]
    got = [(r["page_id"], r["host"], r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(rows, URLS), url_filter.rule_table(spark)).collect()]
    assert sorted(got, key=str) == sorted([(1, "", None, "allow"), (2, "", None, "allow"), (3, "", None, "allow"), (4, "a.example.org", "example.org/es/", "block"), (5, "example.org", "org/", "allow"), (6, "badexample.org", "org/", "allow"), (7, "org", "org/", "allow"), (7, "org", "org/", "allow"), (8, "x.com", None, "allow"), (9, "a.com", None, "allow"), (None, "b.com", "com/de/", "block")], key=str)


def test_url_empty_tables_and_ties(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/xy")], "page_id long, url string")
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark)).count() == 0
    assert url_filter.judge(pages, url_filter.rule_table(spark).limit(0), default="block").first()["verdict"] == "block"
    tie = url_filter.rule_table(spark, [("allow", "c", "/xy"), ("block", "b.c", "/"), ("allow", "b.c", "/")])
    assert url_filter.judge(pages, tie).first()["verdict"] == "block"


def test_url_beyond_the_broadcast_bound_is_the_same(spark, sf_dir, monkeypatch):
    want = {tuple(r) for r in QUERIES["op8_url_filter"](spark, sf_dir).collect()}
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    assert {tuple(r) for r in QUERIES["op8_url_filter"](spark, sf_dir).collect()} == want


def test_no_python_in_native_plans(spark, sf_dir):
    for name in ("op1_mix_sources", "op8_url_filter"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def water(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda n: (n is None, (n or "").encode()))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, open_, target = float(sum(sizes.values())), set(names), {}
    while True:
        left = total - sum(target.values())
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = {n for n in open_ if share[n] > cap * sizes[n]}
        if not over:
            return target | share
        target |= {n: float(cap * sizes[n]) for n in over}
        open_ -= over
        if not open_:
            return target


def test_permutation_is_a_bijection(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 7, 100, 1000):
        seen = [r[0] for r in spark.range(n).select(mixing.permute(F.col("id"), F.lit(n).cast("long"), F.lit(9).cast("long"), 16)).collect()]
        assert sorted(seen) == list(range(n))
    assert seen != list(range(1000))


def test_mix_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows}
    per = defaultdict(int)
    for r in rows:
        per[r["source"]] += size[r["doc_id"]]
    target = water(per)
    got = mixing.mix(docs).collect()
    source = {r["doc_id"]: r["source"] for r in rows}
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], per[s])
        assert abs(r["target"] - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    # A multinomial count of blocks of 32 words: five of its standard deviations, and a block that is not full.
    share = {s: target[s] / sum(per.values()) for s in per}
    assert all(abs(taken[s] - target[s]) < 5 * 32 * (sum(per.values()) / 32 * share[s] * (1 - share[s])) ** 0.5 + 64 for s in per)
    assert {tuple(r) for r in got} == {tuple(r) for r in mixing.mix(docs).collect()}


def signed(u):
    return u - (1 << 64) if u >> 63 else u


def uniform(*key):
    return (_chain(key) >> 11) / 2**53


def swapped(x, n, key):
    for k in range(1, 17):
        other = (signed(_chain((key, np.int32(k)))) % n + n - x) % n
        if signed(_chain((max(x, other), key, np.int32(k)))) & 1:
            x = other
    return x


def plain_mix(rows, per_shard, seed=20240, block=32, cap=3):
    """What each document gives, slot by slot: rows of (doc_id, words, source), all in one list."""
    per, streams = defaultdict(int), defaultdict(list)
    for i, n, s in rows:
        per[s] += n
    text = lambda n: "w " * n
    h = {(i, n): signed(xxhash.xxh64_intdigest(text(n).encode(), 42)) for i, n, _ in rows}
    for i, n, s in sorted(rows, key=lambda r: (signed(_chain((r[0], h[r[0], r[1]]))) % 256, r[0], h[r[0], r[1]])):
        streams[s] += [i] * n
    names = sorted(per)
    target = water(per)
    blocks = [-(-per[s] // block) for s in names]
    draws = [target[s] * b / per[s] for s, b in zip(names, blocks)]
    slots = round(sum(draws))

    def pick(u, weights):
        ends = mixing.cuts(weights)
        return sum(e <= u for e in ends)

    shards = [[pick(uniform(np.int32(seed), k, j), draws) for j in range(min(per_shard, slots - k * per_shard))] for k in range(-(-slots // per_shard))]
    for again in range(1, 6):
        have = [sum(x.count(i) for x in shards) for i in range(len(names))]
        if all(n <= cap * b for n, b in zip(have, blocks)):
            break
        spare, left, new = [max(0, cap * b - n) for n, b in zip(have, blocks)], [cap * b for b in blocks], []
        for k, shard in enumerate(shards):
            kept, over = [], 0
            for i in shard:
                if left[i]:
                    left[i] -= 1
                    kept.append(i)
                else:
                    over += 1
            weights = [d if x else 0.0 for d, x in zip(draws, spare)]
            new.append(kept + [pick(uniform(np.int32(seed), np.int32(again), k, j), weights) for j in range(over)])
        shards = new
    taken, number = defaultdict(int), [0] * len(names)
    for shard in shards:
        for i in shard:
            r, n = number[i], blocks[i]
            number[i] += 1
            b = swapped(r % n, n, signed(_chain((np.int32(seed), np.int32(i), r // n))))
            for doc in streams[names[i]][b * block : (b + 1) * block]:
                taken[doc] += 1
    return taken, shards


def test_mix_takes_follow_the_stated_draw(spark):
    """Three sources with targets off their sizes, one of them at its cap, over several shards: all steps by hand."""
    r = np.random.default_rng(3)
    rows = [(i, int(r.integers(1, 300)), s) for i, s in enumerate("a" * 30 + "b" * 8 + "c" * 3)]
    docs = spark.createDataFrame([(i, "w " * n, s) for i, n, s in rows], "doc_id long, text string, source string")
    for per_shard in (50, 65_536):
        want, shards = plain_mix(rows, per_shard)
        got = {x["doc_id"]: x["taken"] for x in mixing.mix(docs, shard_slots=per_shard).collect()}
        assert got == {i: want.get(i, 0) for i, _, _ in rows}
        assert all(got[i] <= 3 * n for i, n, _ in rows)
        m = mixing.mixture(docs, shard_slots=per_shard).collect()
        assert {(x["shard"], x["slot"]) for x in m} == {(k, j) for k, s in enumerate(shards) for j in range(len(s))}
        told = defaultdict(int)
        for x in m:
            told[x["doc_id"]] += x["words"]
        assert {i: told.get(i, 0) for i in got} == got


def test_counts_of_shards_are_multinomial(spark):
    sources = [(0, 10**6, 500.0), (1, 10**6, 300.0), (2, 10**6, 200.0)]
    got = defaultdict(lambda: [0, 0, 0])
    for x in mixing.draw(spark, sources, 400 * 250, 250, 3, 1).collect():
        got[x["shard"]][x["idx"]] = x["count"]
    counts = np.array(list(got.values()))
    assert counts.shape == (400, 3) and (counts.sum(1) == 250).all()
    for i, p in enumerate((0.5, 0.3, 0.2)):
        assert abs(counts[:, i].mean() - 250 * p) < 4 * (250 * p * (1 - p) / 400) ** 0.5
        assert 0.7 < counts[:, i].var() / (250 * p * (1 - p)) < 1.35


def test_slots_that_cannot_be_filled_draw_again(spark):
    """Sources at their caps, and more draws than one of them can fill."""
    sources = [(0, 10, 30.0), (1, 4, 12.0), (2, 40, 48.0)]
    for rounds in (1, 2, 6):
        counts = mixing.draw(spark, sources, 90, 7, 3, 5, rounds=rounds).collect()
        per = defaultdict(int)
        for x in counts:
            per[x["idx"]] += x["count"]
        assert sum(per.values()) == 90 and all(per[i] <= 3 * b for i, b, _ in sources)


def test_texts_of_the_mix(spark):
    docs = spark.createDataFrame([(1, " a b\tc ", "x"), (2, "d e " * 30, "x"), (2, "d e " * 30, "x"), (None, "f", "y"), (4, None, "y")], "doc_id long, text string, source string")
    got = mixing.texts(docs, block_words=4, shard_slots=10).collect()
    assert all(len(r["text"].split(" ")) == r["n_words"] <= 4 for r in got)
    assert sum(r["n_words"] for r in got) == sum(r["taken"] for r in mixing.mix(docs, block_words=4, shard_slots=10).collect())


def _chain(values, seed=42):
    for v in values:
        size = 4 if isinstance(v, np.int32) else 8
        seed = xxhash.xxh64_intdigest(int(v).to_bytes(size, "little", signed=True), seed)
    return seed


def test_mix_odd_input(spark):
    rows = [(1, None, "a", 1), (2, "", None, 1), (3, "one two\x0bthree\u00a0four", None, 1), (3, "one two\x0bthree\u00a0four", None, 1), (None, "x", "b", 1), (5, "y " * 5000, "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(docs).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == [("1", 0), ("2", 0), ("3", 3), ("3", 3), ("5", 5000), ("None", 1)]
    assert mixing.mix(docs.limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mix(docs.where("doc_id = 1")).collect()] == [0]
