"""Operator 7, toxicity: a classifier chain over categories.

Categories are expressions over the columns of `labels` and are predicted in order. Those of
the query are `junk` (labels.quality is 0), `toxic_junk` (toxic, and quality is 0) and last
`toxic`: marks that people gave, none derived from texts. The linear model of each category
sees the text's cues and the probabilities of all earlier categories; while training, those
are out-of-fold predictions, so a later model learns from what an earlier one says of unseen
texts. Cues are chosen for every model from the rows that it is fitted on alone: in each fold
anew, and for the final models from all.

Features are words (runs of letters, digits and non-ASCII bytes, in lower case) and
their prefixes of 4, 5 and 6 bytes, hashed to 20 bits. The fit takes at most `sample`
labelled documents, by a hash of their id, with at most `sample_bytes` of text and one text
more, and each model keeps the `keep` features with the largest log-odds in them; ties go by
bucket. Every word of every text is looked up when scoring, however long it is; counts enter
as log(1 + n), so one cue in a long text is not thinned out. Features of texts beyond those
that some model keeps never leave the workers.

Null or empty texts get the models' intercepts. With labels of one kind, or none, a category
has their mean, or 0, as its probability. Repeated rows get equal scores; repeated labels
count as the larger one. Rows with a null id or without the last category do not train, and
those without another do not train that one. Empty tables give no rows. Other columns may
have any names; `score` returns those asked for and `accept` all.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Spans, arrow_bytes, fold_letters, keep_where, slices, table, words
from .quality import _sigmoid, labelled_sample

CATEGORIES = {"junk": "quality = 0", "toxic_junk": "toxic = 1 and quality = 0", "toxic": "toxic = 1"}
FOLDS = 4
BITS = 20
PREFIXES = (4, 5, 6)


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, document) of each word and of each prefix."""
    start, end, doc = words(data, offsets)
    if not len(start):
        return []
    spans, shift, out = Spans(fold_letters(data)), np.uint64(64 - BITS), []
    out.append(((spans.hash(start, end) >> shift).astype(np.int64), doc))
    for k in PREFIXES:
        long = np.flatnonzero(end - start > k)
        # A prefix is another feature than a word that is spelled alike.
        h = spans.hash(start[long], start[long] + k) * np.uint64(0x9E3779B97F4A7C15)
        out.append(((h >> shift).astype(np.int64), doc[long]))
    return out


class Logistic:
    """L2 logistic regression by accelerated gradients, classes in balance."""

    def __init__(self):
        self.w, self.b, self.mean = np.zeros(0), 0.0, None

    def constant(self, width: int, mean: float) -> Logistic:
        self.w, self.mean = np.zeros(width, np.float32), mean
        return self

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 200, l2: float = 2e-4) -> Logistic:
        weight = (np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)).astype(np.float32)
        z = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
        probe, top = np.ones(z.shape[1], np.float32), 1.0
        for _ in range(12):  # the largest curvature bounds the step
            probe = z.T @ (weight * (z @ probe))
            top = float(np.linalg.norm(probe))
            probe /= max(top, 1e-12)
        rate = 1 / (0.25 * top * 1.1 + l2)
        w = last = np.zeros(z.shape[1], np.float32)
        for k in range(steps):
            ahead = w + (k / (k + 3)) * (w - last)
            g = z.T @ (weight * (_sigmoid(z @ ahead) - y)) + l2 * ahead
            last, w = w, (ahead - rate * g).astype(np.float32)
            if np.abs(w - last).max() < 1e-4:
                break
        self.w, self.b = w[:-1], float(w[-1])
        return self

    def prob(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.mean) if self.mean is not None else _sigmoid(x @ self.w + self.b)


def best_features(positive: np.ndarray, negative: np.ndarray, total: np.ndarray, keep: int) -> np.ndarray:
    """Buckets with the largest log-odds: in how many documents with the label, without it, and how many of each there are."""
    if not total.all():
        return np.zeros(0, np.int64)
    odds = np.log((positive + 0.25) / (total[1] + 0.5)) - np.log((negative + 0.25) / (total[0] + 0.5))
    odds[positive < (3 if total[1] >= 60 else 2)] = -np.inf
    # Weaker cues than that are more often chance than meaning.
    rank = np.where(odds > 1.5, np.maximum(odds, 0) * np.sqrt(np.minimum(positive, 50)), 0.0)
    best = np.argsort(-rank, kind="stable")[:keep]
    return np.sort(best[rank[best] > 0])


class Texts:
    """Sparse rows of the sample: the documents' kept features, of which parts become dense."""

    def __init__(self, doc: np.ndarray, feature: np.ndarray, value: np.ndarray, docs: int, features: int):
        self.doc, self.feature, self.value, self.docs, self.features = doc, feature, value, docs, features

    def dense(self, columns: np.ndarray, rows: np.ndarray) -> np.ndarray:
        col, row = np.full(self.features, -1), np.full(self.docs, -1)
        col[columns], row[rows] = np.arange(len(columns)), np.arange(len(rows))
        use = np.flatnonzero((col[self.feature] >= 0) & (row[self.doc] >= 0))
        out = np.zeros((len(rows), len(columns)), np.float32)
        out[row[self.doc[use]], col[self.feature[use]]] = self.value[use]
        return out


class Chain:
    """A classifier chain; later models see earlier probabilities. Models have (columns, model) each; slots maps buckets to columns."""

    def __init__(self, slots: np.ndarray, models: list[tuple[np.ndarray, Logistic]], names: list[str]):
        self.slots, self.models, self.names = slots, models, names
        self.features = int(slots.max()) + 1

    @staticmethod
    def fit(slots: np.ndarray, texts: Texts, ys: np.ndarray, fold_of: np.ndarray, chosen: dict[tuple[int, int], np.ndarray], names: list[str]) -> Chain:
        """ys: documents x categories, -1 where a mark is missing. chosen: the columns of (category, fold left out), -1 for none left out."""
        out, seen = [], np.zeros((texts.docs, 0), np.float32)

        def model(k: int, without: int) -> tuple[np.ndarray, Logistic]:
            rows = np.flatnonzero((ys[:, k] >= 0) & (fold_of != without))
            if not len(rows):
                return np.zeros(0, np.int64), Logistic().constant(seen.shape[1], 0.0)
            y, columns = (ys[rows, k] > 0).astype(np.float32), chosen[k, without]
            if y.min() == y.max():
                return np.zeros(0, np.int64), Logistic().constant(seen.shape[1], float(y[0]))
            return columns, Logistic().fit(np.concatenate([texts.dense(columns, rows), seen[rows]], 1), y)

        for k in range(ys.shape[1]):
            out.append(model(k, -1))
            if k + 1 < ys.shape[1]:
                unseen = np.zeros(texts.docs, np.float32)
                for f in range(FOLDS):
                    rows = np.flatnonzero(fold_of == f)
                    columns, m = model(k, f)
                    unseen[rows] = m.prob(np.concatenate([texts.dense(columns, rows), seen[rows]], 1))
                seen = np.concatenate([seen, unseen[:, None]], 1)
        return Chain(slots, out, names)

    def predict(self, doc: np.ndarray, feature: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
        """Probabilities (docs x categories) of sparse rows."""
        out = np.zeros((docs, len(self.models)))
        for k, (columns, m) in enumerate(self.models):
            if m.mean is not None:
                out[:, k] = m.mean
                continue
            w = np.zeros(max(self.features, 1))
            w[columns] = m.w[: len(columns)]
            margin = np.bincount(doc, weights=value * w[feature], minlength=docs) + m.b
            out[:, k] = _sigmoid(margin + out[:, :k] @ m.w[len(columns) :].astype(np.float64))
        return out


def sparse(slots: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, kept feature, log(1 + count)) of the texts."""
    found, n = [], int(slots.max()) + 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for bucket, doc in hashed_words(data, offsets):
        f = slots[bucket]
        hit = np.flatnonzero(f >= 0)
        found.append(doc[hit] * n + f[hit])
    key, count = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
    return key // max(n, 1), key % max(n, 1), np.log1p(count)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, sample: int = 8000, keep: int = 512, sample_bytes: int = 64 << 20) -> Chain:
    """Trains on the driver; two passes over the sample's texts, which are put in the shared folder once."""
    categories = CATEGORIES if categories is None else categories
    names, many = list(categories), len(categories)
    rows = labelled_sample(docs, labels, list(categories.values()), sample, sample_bytes)
    fold = F.pmod(F.xxhash64(F.lit(23), "_id", "text"), F.lit(FOLDS)).cast("int")
    rows = rows.withColumn("fold", fold)
    kind = np.uint16 if sample < 1 << 16 else np.int32

    def tally(batches):
        import pyarrow as pa

        # In how many documents a bucket is, by fold: of any kind, and with and without each mark.
        seen, total = np.zeros((FOLDS, many, 2, 1 << BITS), kind), np.zeros((FOLDS, many, 2), np.int64)
        flat = seen.reshape(-1)
        for batch in batches:
            for part in slices(batch):
                y = np.array(part.column("y").to_pylist(), np.int64).reshape(-1, many)
                f = part.column("fold").to_numpy().astype(np.int64)
                pairs = [d * (1 << BITS) + b for b, d in hashed_words(*arrow_bytes(part.column("text")))]
                pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
                d, b = pairs >> BITS, pairs & ((1 << BITS) - 1)
                for k in range(many):
                    known = y[:, k] >= 0
                    np.add.at(total, (f[known], k, y[known, k]), 1)
                    on = known[d]
                    d_, b_ = d[on], b[on]
                    np.add.at(flat, (((f[d_] * many + k) * 2 + y[d_, k]) << BITS) + b_, kind(1))
        for at in np.ndindex(FOLDS, many, 2):
            some = np.flatnonzero(seen[at]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.int32()) for x in at], pa.array([int(total[at])], pa.int64()), pa.array([some.tobytes()], pa.binary()), pa.array([seen[at][some].tobytes()], pa.binary())], ["fold", "k", "side", "total", "some", "many"])

    seen, total = np.zeros((FOLDS, many, 2, 1 << BITS), kind), np.zeros((FOLDS, many, 2), np.int64)
    for r in rows.repartition(4).mapInArrow(tally, "fold int, k int, side int, total long, some binary, many binary").toLocalIterator():
        at = r["fold"], r["k"], r["side"]
        total[at] += r["total"]
        seen[at][np.frombuffer(r["some"], np.int32)] += np.frombuffer(r["many"], kind)
    buckets = {}
    for k in range(many):
        for without in range(-1, FOLDS):
            use = [f for f in range(FOLDS) if f != without]
            (no, yes), t = seen[use, k].sum(0, dtype=np.int64), total[use, k].sum(0)
            buckets[k, without] = best_features(yes, no, t, keep)
    del seen
    every = np.unique(np.concatenate(list(buckets.values())))
    slots = np.full(1 << BITS, -1, np.int32)
    slots[every] = np.arange(len(every))
    chosen = {key: np.searchsorted(every, b) for key, b in buckets.items()}

    def featurize(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                doc, feature, value = sparse(slots, *arrow_bytes(part.column("text")))
                at = np.searchsorted(doc, np.arange(part.num_rows + 1))
                pack = lambda a, t: pa.array([a[i:j].astype(t).tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("y"), part.column("fold"), pack(feature, np.int32), pack(value, np.float32)], ["_id", "y", "fold", "feature", "value"])

    got = sorted(rows.mapInArrow(featurize, "_id long, y array<int>, fold int, feature binary, value binary").collect(), key=lambda r: (r["_id"], bytes(r["feature"]), bytes(r["value"]), r["fold"]))
    feature, value = [np.frombuffer(r["feature"], np.int32) for r in got], [np.frombuffer(r["value"], np.float32) for r in got]
    doc = np.repeat(np.arange(len(got)), [len(f) for f in feature])
    join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
    texts = Texts(doc, join(feature, np.int32), join(value, np.float32), len(got), max(1, len(every)))
    ys = np.array([r["y"] for r in got], np.int64).reshape(-1, many)
    chain = Chain.fit(slots, texts, ys, np.array([r["fold"] for r in got], np.int64), chosen, names)
    # Scoring looks up what the final models keep, and nothing that only a fold's model did.
    last = np.unique(np.concatenate([np.zeros(0, np.int64), *[c for c, _ in chain.models]]))
    slots = np.full(1 << BITS, -1, np.int32)
    slots[every[last]] = np.arange(len(last))
    return Chain(slots, [(np.searchsorted(last, c), m) for c, m in chain.models], names)


def score(docs: DataFrame, chain: Chain, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of every document with a probability for each category."""
    keep = keep or ["doc_id"]
    kinds = [docs.schema[c] for c in keep]
    given = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                p = chain.predict(*sparse(chain.slots, *arrow_bytes(part.column("text"))), part.num_rows)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], *[pa.array(p[:, k], pa.float64()) for k in range(len(chain.names))]], [*[f"_k{i}" for i in range(len(keep))], *[f"_p{k}" for k in range(len(chain.names))]])

    schema = ", ".join([*[f"_k{i} {k.dataType.simpleString()}" for i, k in enumerate(kinds)], *[f"_p{k} double" for k in range(len(chain.names))]])
    return given.mapInArrow(work, schema).toDF(*keep, *[f"p_{c}" for c in chain.names])


def accept(docs: DataFrame, chain: Chain, below: float = 0.5) -> DataFrame:
    """The documents whose last category has a probability under `below`."""

    def wanted(data, offsets):
        return chain.predict(*sparse(chain.slots, data, offsets), len(offsets) - 1)[:, -1] < below

    return keep_where(docs, wanted)


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).withColumn("toxic", F.col("p_toxic") >= 0.5)
