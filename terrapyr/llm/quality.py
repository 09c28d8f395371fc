"""Operator 10, quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of 64 words (white-space words; the last may be shorter; a
text without words is one empty passage). Every passage is encoded: twelve measures of its
bytes and words, and the learned embeddings of its words and pairs of words, hashed to 4096
buckets, go through one layer. Gated attention (Ilse, Tomczak, Welling 2018) weighs the
passages, and a logistic unit scores the weighted sum. Document labels alone train all of it.

The fit takes at most `sample` labelled documents, those that come first by a hash of their
id (ties by id), with at most `sample_bytes` characters and one text more, and only ids whose
crc32 modulo 5 is not 0; the rest is held out. Rows with a null label are not used, the larger
of conflicting labels counts. With labels of one kind, or none, all scores are their mean, or
0.5. Null texts are empty ones. Very long texts are scored whole, a batch of 1 MB or one text
at a time. Repeated rows get equal scores. Empty tables give no rows. Neither labels, lang,
source nor doc_id is an input of a score; other columns may have any names, and come back where
they are asked for.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import _ODD, Spans, arrow_bytes, fold, keep_where, mix, settle, slices, table, words

PASSAGE = 64
WIDTH = 12
#: Buckets of words and pairs of words, as a power of two.
BITS = 12
_CLASS = np.zeros((5, 256), np.uint8)
_CLASS[0, 65:91] = 1  # upper case
_CLASS[1, [*range(65, 91), *range(97, 123), *range(128, 256)]] = 1  # letters
_CLASS[2, 48:58] = 1  # digits
_CLASS[3, [x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in ".,;:'\"-?()"]] = 1  # symbols
_CLASS[4, 10] = 1  # line ends


class Bags:
    """Passages of some documents: measures x, n+1 offsets of the documents' passages, and the buckets of each passage (n+1 offsets too)."""

    def __init__(self, x: np.ndarray, base: np.ndarray, bucket: np.ndarray, start: np.ndarray):
        self.x, self.base, self.bucket, self.start = x, base, bucket, start

    @staticmethod
    def join(parts: list[Bags]) -> Bags:
        run = lambda k: np.concatenate([[0], *[getattr(p, k)[1:] + add for p, add in zip(parts, np.cumsum([0, *[getattr(q, k)[-1] for q in parts[:-1]]]))]])
        return Bags(np.concatenate([p.x for p in parts]), run("base").astype(np.int64), np.concatenate([p.bucket for p in parts]), run("start").astype(np.int64))

    def pooled(self, table_: np.ndarray) -> np.ndarray:
        """The sum of each passage's rows of the table, over the root of their number."""
        out, many = np.zeros((len(self.x), table_.shape[1]), table_.dtype), np.diff(self.start)
        some = np.flatnonzero(many)
        for i in range(0, len(some), 256):  # rows are looked up a bounded part at a time
            part = some[i : i + 256]
            a, b = self.start[part[0]], self.start[part[-1] + 1]
            out[part] = np.add.reduceat(table_[self.bucket[a:b]], self.start[part] - a, axis=0)
        return out / np.sqrt(np.maximum(many, 1))[:, None].astype(table_.dtype)

    def spread(self, grad: np.ndarray, rows: int) -> np.ndarray:
        """The gradient of the table, of that of what was pooled."""
        many = np.diff(self.start)
        each = (grad / np.sqrt(np.maximum(many, 1))[:, None]).astype(np.float32)
        order = np.argsort(self.bucket, kind="stable")
        of = np.repeat(np.arange(len(many)), many)[order]
        hit, first = np.unique(self.bucket[order], return_index=True)
        out = np.zeros((rows, grad.shape[1]), np.float32)
        if len(hit):
            out[hit] = np.add.reduceat(each[of], first, axis=0)
        return out


def passages(data: np.ndarray, offsets: np.ndarray) -> Bags:
    docs = len(offsets) - 1
    start, end, doc = words(data, offsets, solid=True)
    count = np.bincount(doc, minlength=docs)
    per_doc = np.maximum(1, -(-count // PASSAGE))
    base = np.concatenate([[0], np.cumsum(per_doc)])
    x, n = np.zeros((base[-1], WIDTH), np.float32), int(base[-1])
    if not len(start):
        return Bags(x, base, np.zeros(0, np.uint16), np.zeros(n + 1, np.int64))
    rank = np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count)
    at = base[doc] + rank // PASSAGE
    size = np.bincount(at, minlength=n).astype(np.float32)
    some = np.maximum(size, 1)
    h = Spans(fold(data)).hash(start, end)
    last, first = data[end - 1], data[start]
    # Bytes of a passage: from its first word to the next passage's, or the text's end.
    filled = np.flatnonzero(size)
    head = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    lead = start[head]
    past = np.minimum(np.concatenate([lead[1:], [len(data)]]), offsets[doc[head] + 1])
    tally = np.zeros((5, n), np.float32)
    for k in range(5):
        seen = np.concatenate([[0], np.cumsum(_CLASS[k][data], dtype=np.int64)])
        tally[k, filled] = seen[past] - seen[lead]
    span = np.zeros(n, np.float32)
    span[filled] = past - lead
    span = np.maximum(span, 1)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (at[1:] == at[:-1])
    by_hash = np.argsort(h, kind="stable")
    order = by_hash[np.argsort(at[by_hash], kind="stable")]
    hs, as_ = h[order], at[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (as_[1:] != as_[:-1])
    mean = lambda v: np.bincount(at, weights=v, minlength=n).astype(np.float32) / some
    x[:, 0] = tally[0] / np.maximum(tally[1], 1)
    x[:, 1] = tally[1] / span
    x[:, 2] = tally[2] / span
    x[:, 3] = np.sqrt(tally[3] / span)
    x[:, 4] = np.sqrt(tally[4] / span)
    x[:, 5] = size / PASSAGE
    x[:, 6] = mean(end - start) / 10
    x[:, 7] = mean(same)
    x[:, 8] = np.bincount(as_[new], minlength=n) / some
    x[:, 9] = mean(_CLASS[3][last])
    x[:, 10] = mean((end - start == 1) & (_CLASS[3][first] > 0))
    x[:, 11] = mean(np.isin(last, np.frombuffer(b".,;:?!", np.uint8)))
    shift = np.uint64(64 - BITS)
    grams, there = np.zeros((len(h), 2), np.uint16), np.ones((len(h), 2), bool)
    with np.errstate(over="ignore"):
        grams[:, 0] = h >> shift
        grams[:-1, 1] = mix(h[:-1] * _ODD + h[1:]) >> shift
    there[:-1, 1], there[-1, 1] = at[1:] == at[:-1], False
    many = np.bincount(np.repeat(at, 2)[there.ravel()], minlength=n)
    return Bags(x, base, grams[there], np.concatenate([[0], np.cumsum(many)]))


def _sigmoid(v):
    return 0.5 * (1 + np.tanh(0.5 * v))


class AttentionMIL:
    """tanh encoding, gated attention, logistic score; trained by Adam."""

    def __init__(self, width: int = WIDTH, hidden: int = 24, gate: int = 12, buckets: int = 1 << BITS, seed: int = 7):
        r = np.random.default_rng(seed)
        draw = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"W": draw(width, hidden), "b": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate), "c": draw(hidden), "d": np.zeros(1)}
        self.p["E"] = r.normal(0, 0.05, (buckets, hidden)).astype(np.float32)
        self.mean, self.scale, self.constant = np.zeros(width), np.ones(width), None

    def _forward(self, x: np.ndarray, bags: Bags):
        """x: the measures, scaled."""
        p, base = self.p, bags.base
        h = np.tanh(x @ p["W"] + bags.pooled(p["E"]) + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        a = (t * s) @ p["w"]
        starts, bag = base[:-1], np.repeat(np.arange(len(base) - 1), np.diff(base))
        e = np.exp(a - np.maximum.reduceat(a, starts)[bag])
        e /= np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(e[:, None] * h, starts, axis=0)
        return h, t, s, e, z, bag, z @ p["c"] + p["d"][0]

    def score(self, bags: Bags) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bags.base) - 1, self.constant)
        if len(bags.base) < 2:
            return np.zeros(0)
        return _sigmoid(self._forward((bags.x - self.mean) / self.scale, bags)[-1])

    def gradients(self, x: np.ndarray, bags: Bags, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted log-loss, by parameter."""
        p, g = self.p, {}
        h, t, s, e, z, bag, out = self._forward(x, bags)
        do = weight * (_sigmoid(out) - y)
        g["c"], g["d"] = z.T @ do, np.array([do.sum()])
        dz = do[:, None] * p["c"]
        de = (dz[bag] * h).sum(1)
        da = e * (de - np.add.reduceat(e * de, bags.base[:-1])[bag])
        dh = e[:, None] * dz[bag]
        g["w"] = (t * s).T @ da
        dts = da[:, None] * p["w"]
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        g["V"], g["U"] = h.T @ dt, h.T @ ds
        dh = (dh + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        g["W"], g["b"], g["E"] = x.T @ dh, dh.sum(0), bags.spread(dh, len(p["E"]))
        return g

    def fit(self, bags: list[Bags], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 11) -> AttentionMIL:
        """bags: one for each document."""
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        whole = np.concatenate([b.x for b in bags]).astype(np.float64)
        self.mean, self.scale = whole.mean(0), whole.std(0) + 1e-3
        r, m, v, step = np.random.default_rng(seed), {k: 0 * a for k, a in self.p.items()}, {k: 0 * a for k, a in self.p.items()}, 0
        weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        for epoch in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(y), batch):
                pick = order[i : i + batch]
                part = Bags.join([bags[k] for k in pick])
                g = self.gradients((part.x - self.mean) / self.scale, part, y[pick], weight[pick] / len(pick))
                step += 1
                at = rate * (1 - 0.9 * epoch / epochs)
                for k, p in self.p.items():
                    grad = g[k] + decay * p
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad**2
                    self.p[k] = (p - at * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(p.dtype)
        return self


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, marks: list[str], sample: int, sample_bytes: int, also=None) -> DataFrame:
    """(_id, text, y) of at most `sample` labelled documents, by a hash of their id; ties go by id. y: an int for each mark, -1 where it is null; the last one never is. Of these, texts are taken in order while all before them have no more than `sample_bytes` characters."""
    given = labels.select(F.col("doc_id").alias("_id"), *[F.expr(f"cast({m} as int)").alias(f"y{i}") for i, m in enumerate(marks)]).where(f"_id is not null and y{len(marks) - 1} is not null")
    if also is not None:
        given = given.where(also(F.col("_id")))
    y = F.array(*[F.coalesce(F.max(f"y{i}"), F.lit(-1)) for i in range(len(marks))])
    given = given.groupBy("_id").agg(y.alias("y")).join(docs.select(F.col("doc_id").alias("_id")), "_id", "left_semi")
    given = given.orderBy(F.xxhash64(F.lit(17), "_id"), "_id").limit(sample)
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = settle(texts.join(F.broadcast(given), "_id").select("_id", "text", "y"), "sample")
    sizes = rows.select("_id", F.length("text").alias("size"), F.xxhash64("text").alias("h"))
    # One window over the sample's sizes, which are as many as its rows.
    order = W.orderBy(F.xxhash64(F.lit(17), "_id"), "_id", "h").rowsBetween(W.unboundedPreceding, -1)
    fits = sizes.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))).where(F.col("before") <= sample_bytes).select("_id", "h").distinct()
    return rows.join(F.broadcast(fits), (rows["_id"] == fits["_id"]) & (F.xxhash64(rows["text"]) == fits["h"]), "left_semi")


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, label: str = "quality", sample_bytes: int = 32 << 20) -> AttentionMIL:
    """Trains on the driver, on features of the sample."""

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                bags = passages(*arrow_bytes(part.column("text")))
                many = np.diff(bags.start).astype(np.int32)
                ends = list(zip(bags.base[:-1], bags.base[1:]))
                pack = lambda parts: pa.array([x.tobytes() for x in parts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("y"), pack(bags.x[a:b] for a, b in ends), pack(many[a:b] for a, b in ends), pack(bags.bucket[bags.start[a] : bags.start[b]] for a, b in ends)], ["_id", "y", "x", "many", "bucket"])

    rows = labelled_sample(docs, labels, [label], sample, sample_bytes, lambda i: ~held_out(i)).mapInArrow(encode, "_id long, y array<int>, x binary, many binary, bucket binary").collect()
    rows = sorted(rows, key=lambda r: (r["_id"], bytes(r["x"]), bytes(r["bucket"])))

    def bag(r) -> Bags:
        x, many = np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH), np.frombuffer(r["many"], np.int32)
        return Bags(x, np.array([0, len(x)]), np.frombuffer(r["bucket"], np.uint16), np.concatenate([[0], np.cumsum(many)]))

    return AttentionMIL().fit([bag(r) for r in rows], np.array([float(r["y"][0] > 0) for r in rows]))


def score(docs: DataFrame, model: AttentionMIL, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of every document, with its score."""
    keep = keep or ["doc_id"]
    kinds = [docs.schema[c] for c in keep]
    given = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], pa.array(model.score(passages(*arrow_bytes(part.column("text")))), pa.float64())], [*[f"_k{i}" for i in range(len(keep))], "_score"])

    schema = ", ".join(f"_k{i} {k.dataType.simpleString()}" for i, k in enumerate(kinds)) + ", _score double"
    return given.mapInArrow(work, schema).toDF(*keep, "score")


def accept(docs: DataFrame, model: AttentionMIL, least: float = 0.3) -> DataFrame:
    """The documents with a score of `least` or more."""

    def wanted(data, offsets):
        return model.score(passages(data, offsets)) >= least

    return keep_where(docs, wanted)


def op10_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
