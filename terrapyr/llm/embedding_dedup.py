"""Operator 9, embedding near-dedup over a robust-pruned flat graph.

Vectors with one label are dealt to regions of at most `region_rows`: each goes to those of its
`overlap` nearest centres, so regions overlap. A task holds one region. There vectors are dealt
again to overlapping cluster shards of some hundreds; in every shard a flat graph is built by
robust pruning (Subramanya and others, "DiskANN", 2019), and a vector's adjacency lists from
all its shards are united. Every vector is then searched for through the whole region: greedy
beam search from the nearest shards' medoids and from its own node, then range expansion, which
follows the edges of everything found within range until nothing new is; where a good part of
the region is in range, the rest is looked at directly. What is found is verified by cosine in
double precision, counts both ways, and in the first region that both vectors have. `audit`
measures recall against brute force.

Centres are vectors picked by hash, about one for `spacing` vectors and `max_centres` in all,
less those that lie close to one kept before. A region that is still too large is split on
the executors by centres of its own, and again, as long as it has centres that lie apart. What
then is too large is a group of near copies: it is cut into blocks, of which every pair is one
bounded task. Tasks return a count and a root for each vector, never pairs, so a group of near
copies costs rows in proportion to its size, and time with the square of it.

Equal vectors of one label are one class with a count; they need no search. Classes are told
apart by 64-bit hashes. Null, empty or zero vectors, those with null or non-finite components,
and null labels link with nothing; vectors of other lengths neither, however long they are.
Repeated rows are vectors of their own; ties in the order of a search go by class hash, so
reruns agree. An empty table gives no rows. Other columns may have any names; they are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table
from .components import components, forest

#: Rows of a shard, and of a step of the search.
SHARD, STEP = 256, 256


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, whatever precision they are kept in."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def robust_prune(x: np.ndarray, degree: int, alpha: float, near: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Edges of unit vectors: each keeps those of its `near` nearest neighbours that no kept one is `alpha` times closer to."""
    n = len(x)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    far = np.maximum(0, 2 - 2 * (x @ x.T))
    np.fill_diagonal(far, np.inf)
    near, rows = min(near, n - 1), np.arange(n)
    cand = np.argpartition(far, near - 1, 1)[:, :near] if near < n - 1 else np.argsort(far, 1)[:, :near]
    alive, out = np.take_along_axis(far, cand, 1), []
    own = alive.copy()
    for _ in range(min(degree, near)):
        best = alive.argmin(1)
        good = np.flatnonzero(np.isfinite(alive[rows, best]))
        if not len(good):
            break
        pick = cand[rows, best]
        out.append((rows[good], pick[good]))
        # Squared distances: alpha counts twice.
        alive[alpha * alpha * far[pick[:, None], cand] <= own] = np.inf
        alive[rows, best] = np.inf
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def spread_out(x: np.ndarray, apart: float) -> np.ndarray:
    """Rows, in order, that are less similar than `apart` to all kept before."""
    kept, many, out = np.empty_like(x), 0, []
    for i in range(len(x)):
        if not many or (kept[:many] @ x[i]).max() < apart:
            kept[many] = x[i]
            many += 1
            out.append(i)
    return np.array(out, np.int64)


def nearest(x: np.ndarray, centres: np.ndarray, many: int) -> np.ndarray:
    """The `many` nearest centres of each row."""
    many = min(many, len(centres))
    out = np.empty((len(x), many), np.int64)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = np.argpartition(-(x[i : i + 4096] @ centres.T), many - 1, 1)[:, :many]
    return np.sort(out, 1)


class Graph:
    """The united adjacency lists of overlapping shards, and their medoids."""

    def __init__(self, x: np.ndarray, degree: int, alpha: float, overlap: int, apart: float):
        n = len(x)
        shards = [np.arange(n)]
        if n > 2 * SHARD:
            centres = x[np.linspace(0, n - 1, n // SHARD).astype(np.int64)]
            home = nearest(x, centres[spread_out(centres, apart)], overlap)
            order = np.argsort(home.ravel(), kind="stable")
            ends = np.searchsorted(home.ravel()[order], np.arange(home.max() + 2))
            # A shard of near copies is cut; its parts' medoids are all starts.
            shards = [part for a, b in zip(ends[:-1], ends[1:]) if b > a for part in np.array_split(order[a:b] // home.shape[1], -(-(b - a) // (2 * SHARD)))]
        edges, self.medoids = [], []
        for rows in shards:
            a, b = robust_prune(x[rows], degree, alpha)
            edges += [rows[a] * n + rows[b], rows[b] * n + rows[a]]
            self.medoids.append(rows[(x[rows] @ x[rows].mean(0)).argmax()])
        edges = np.unique(np.concatenate(edges))
        self.x, self.medoids = x, np.unique(self.medoids)
        self.flat, self.start = edges % n, np.searchsorted(edges // n, np.arange(n + 1))

    def around(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into node, neighbour) of all neighbours."""
        many = self.start[node + 1] - self.start[node]
        which = np.repeat(np.arange(len(node)), many)
        return which, self.flat[np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + self.start[node][which]]

    def search(self, asked: np.ndarray, limit: float, beam: int = 8, wide: float = 0.1) -> np.ndarray:
        """Similarities (asked nodes x all nodes) as far as the search came across them, -2 elsewhere."""
        x, n, m = self.x, len(self.x), len(asked)
        q, rows = x[asked], np.arange(m)
        sims, done = np.full((m, n), -2, x.dtype), np.zeros((m, n), bool)

        def look(row: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            key = np.unique((row * n + node)[sims[row, node] == -2])
            row, node = key // n, key % n
            for i in range(0, len(key), 1 << 16):
                s = slice(i, i + (1 << 16))
                sims[row[s], node[s]] = np.einsum("ij,ij->i", q[row[s]], x[node[s]])
            return row, node

        sims[:, self.medoids] = q @ x[self.medoids].T
        sims[rows, asked] = 1
        some = np.unique(np.concatenate([self.medoids, asked]))
        top = np.argsort(-sims[:, some], 1, kind="stable")[:, :beam]
        best = some[top]
        while True:
            score = np.take_along_axis(sims, best, 1)
            open_ = ~np.take_along_axis(done, best, 1) & (score > -2)
            r, c = np.nonzero(open_)
            if not len(r):
                break
            node = best[r, c]
            done[r, node] = True
            which, to = self.around(node)
            row, new = look(r[which], to)
            if not len(row):
                continue
            # The best seen so far: the old ones and what is new, one padded row each.
            many = np.bincount(row, minlength=m)
            pad = np.full((m, many.max()), -1)
            pad[row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)] = new
            pool = np.concatenate([best, pad], 1)
            value = np.where(pool >= 0, np.take_along_axis(sims, np.maximum(pool, 0), 1), -3)
            keep = np.argpartition(-value, beam - 1, 1)[:, :beam] if pool.shape[1] > beam else np.tile(np.arange(pool.shape[1]), (m, 1))
            best = np.take_along_axis(pool, keep, 1)
            best = np.where(best < 0, asked[:, None], best)
        while True:
            front = (sims >= limit) & ~done
            full = np.flatnonzero(front.any(1) & ((sims >= limit).sum(1) > max(wide * n, 4 * beam)))
            if len(full):
                sims[full] = q[full] @ x.T
                done[full] = True
                front[full] = False
            r, node = np.nonzero(front)
            if not len(r):
                return sims
            done[r, node] = True
            which, to = self.around(node)
            look(r[which], to)


def _valid(label: str, vector: str):
    odd = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(F.col(label).isNotNull() & F.col(vector).isNotNull() & ~odd & F.exists(vector, lambda v: v != 0), F.lit(False))


def classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(cls, label, vector, n, first_id) of the distinct valid vectors, and (vec_id, cls) of all rows; cls is null for invalid ones."""
    label = F.concat_ws(":", F.col(label_col).cast("string"), F.size(vector_col))
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).alias("vec_id"), label.alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"), _valid(label_col, vector_col).alias("ok"))
    rows = rows.withColumn("cls", F.when(F.col("ok"), F.xxhash64("label", "vector")))
    return rows.where("ok").groupBy("cls").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("n"), F.min("vec_id").alias("first_id")), rows.select("vec_id", "cls")


def _pick(share) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(3), "cls"), 11).cast("double") / F.lit(float(2**53)) < share


def _centres(found: DataFrame, spacing: int, region_rows: int, max_centres: int, apart: float) -> dict[str, np.ndarray]:
    """Unit centres of every label that needs more than one region; max_centres bounds them all."""
    sizes = found.groupBy("label").agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    rows = max(spacing, -(-total // max_centres))
    large = sizes.where(F.col("size") > max(region_rows, rows)).select("label", (F.lit(1.0) / rows).alias("part"))
    out: dict[str, list] = {}
    for r in sorted(found.join(large, "label").where(_pick(F.col("part"))).select("label", "cls", "vector").collect(), key=lambda r: (r["label"], r["cls"])):
        out.setdefault(r["label"], []).append(r["vector"])
    got = {}
    for label, v in out.items():
        v = unit(np.array(v))
        got[label] = v[spread_out(v, apart)]
    return got


def _matrix(column) -> np.ndarray:
    """Unit vectors of an Arrow list column whose lists are equally long."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))


def _lists(rows: np.ndarray):
    """An Arrow list column of the rows of a matrix."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel(), pa.int64()))


def _split(routed: DataFrame, region_rows: int, fan: int, overlap: int, apart: float) -> DataFrame | None:
    """The same rows with regions beyond region_rows split by centres of their own; None if there is nothing to split."""
    sizes = routed.select("label", F.explode("homes").alias("region")).groupBy("label", "region").agg(F.count("*").alias("size"))
    big = settle(sizes.where(F.col("size") > region_rows), "large-regions")
    if not big.limit(1).count():
        return None
    parts = F.ceil(F.col("size") / region_rows)
    inside = routed.select("cls", "label", "vector", F.explode("homes").alias("region")).join(big, ["label", "region"])
    members = inside.withColumn("part", F.pmod(F.xxhash64(F.lit(11), "cls"), parts)).drop("size")
    picked = settle(inside.where(_pick(fan / F.col("size"))).select("label", "region", "cls", "vector", parts.alias("parts")), "centres")
    picked = picked.select("label", "region", "cls", "vector", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))

    def deal(mine, centres):
        import pyarrow as pa

        region = mine.column("region")
        homes = np.array(region)[:, None]
        if len(centres) > 1 and len(mine):
            v = _matrix(centres.sort_by("cls").column("vector"))
            v = v[spread_out(v, apart)]
            if len(v) > 1:
                # A part's name follows from the region's and the centre's number.
                with np.errstate(over="ignore"):
                    homes = (homes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + nearest(_matrix(mine.column("vector")), v, overlap).astype(np.uint64) + np.uint64(1)).view(np.int64)
        return pa.table({"cls": mine.column("cls"), "label": mine.column("label"), "region": region, "parts": _lists(homes)})

    dealt = members.groupBy("label", "region", "part").cogroup(picked.groupBy("label", "region", "part")).applyInArrow(deal, "cls long, label string, region long, parts array<long>")
    dealt = settle(dealt, "dealt")
    if not dealt.where((F.size("parts") > 1) | (F.get("parts", F.lit(0)) != F.col("region"))).limit(1).count():
        return None
    moved = dealt.groupBy("cls").agg(F.flatten(F.collect_list("parts")).alias("parts"), F.collect_list("region").alias("left"))
    new = routed.join(moved, "cls", "left")
    homes = F.array_sort(F.array_distinct(F.concat(F.array_except("homes", F.coalesce("left", F.array().cast("array<long>"))), F.coalesce("parts", F.array().cast("array<long>")))))
    return settle(new.select("cls", "label", "n", "vector", homes.alias("homes")), "routed")


def near_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", limit: float = 0.93, overlap: int = 3, degree: int = 12, alpha: float = 1.2, region_rows: int = 8192, spacing: int = 1500, max_centres: int = 16_384, fan: int = 256, apart: float = 0.7, levels: int = 3) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    found, members = classes(vectors, id_col, vector_col, label_col)
    found = settle(found, "classes")
    centres = _centres(found, spacing, region_rows, max_centres, apart)
    kind = found.schema["vector"].dataType.simpleString()

    def route(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for label in pc.unique(batch.column("label")).to_pylist():
                part = batch.filter(pc.equal(batch.column("label"), label))
                c = centres.get(label)
                homes = nearest(_matrix(part.column("vector")), c, overlap) if c is not None and len(c) > 1 else np.zeros((part.num_rows, 1), np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(homes)], ["cls", "label", "n", "vector", "homes"])

    routed = settle(found.select("cls", "label", "n", "vector").mapInArrow(route, f"cls long, label string, n long, vector {kind}, homes array<long>"), "routed")
    for _ in range(levels):
        again = _split(routed, region_rows, fan, overlap, apart)
        if again is None:
            break
        routed = again
    half = region_rows // 2
    sizes = routed.select("label", F.explode("homes").alias("region")).groupBy("label", "region").agg(F.count("*").alias("size"))
    # Regions with one block are the rule; the table of those with more stays small.
    many = settle(sizes.where(F.col("size") > region_rows).select("label", "region", F.ceil(F.col("size") / half).alias("blocks")), "blocks")
    spread = routed.select("*", F.explode("homes").alias("region")).join(many, ["label", "region"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).withColumn("block", F.pmod(F.xxhash64(F.lit(9), "cls"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    grouped = spread.select("label", "region", "block", "cls", "n", "vector", "homes", other.alias("with")).select("label", "region", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "cls", "n", "vector", "homes")

    def search(group):
        import pyarrow as pa

        group = group.sort_by("cls")
        ids, n, block = (group.column(c).to_numpy() for c in ("cls", "n", "block"))
        region, sides = group.column("region")[0].as_py(), group.column("low")[0].as_py() != group.column("high")[0].as_py()
        x = _matrix(group.column("vector"))
        lists = group.column("homes").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        home = np.full((len(ids), size.max()), -1)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        held = np.zeros((len(ids), size.max()), bool)
        home[np.repeat(np.arange(len(ids)), size), at] = lists.flatten().to_numpy()
        held[np.repeat(np.arange(len(ids)), size), at] = True
        near = np.zeros((len(ids), len(ids)), bool)
        graph = Graph(x.astype(np.float32), degree, alpha, overlap, apart)
        for i in range(0, len(ids), STEP):
            asked = np.arange(i, min(i + STEP, len(ids)))
            a, b = np.nonzero(graph.search(asked, limit - 1e-5) >= limit - 1e-5)
            for k in range(0, len(a), 1 << 16):  # verified, in double precision
                p, r = asked[a[k : k + (1 << 16)]], b[k : k + (1 << 16)]
                true = (np.einsum("ij,ij->i", x[p], x[r]) >= limit) & (p != r)
                near[p[true], r[true]] = near[r[true], p[true]] = True
        links, ea, eb = np.zeros(len(ids), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i in range(0, len(ids), STEP):
            a, b = np.nonzero(near[i : i + STEP])
            a += i
            if sides:
                cross = block[a] != block[b]
                a, b = a[cross], b[cross]
            if not len(a):
                continue
            x_, y_ = forest(np.concatenate([ea, ids[a]]), np.concatenate([eb, ids[b]]))
            ea, eb = x_, y_
            for k in range(0, len(a), 1 << 18):
                p, r = a[k : k + (1 << 18)], b[k : k + (1 << 18)]
                first = np.full(len(p), np.iinfo(np.int64).max)
                for j in range(home.shape[1]):  # the smallest region that both have
                    both = held[p, j] & ((home[r] == home[p, j][:, None]) & held[r]).any(1)
                    first = np.where(both, np.minimum(first, home[p, j]), first)
                mine = first == region
                links += np.bincount(p[mine], weights=n[r[mine]], minlength=len(ids)).astype(np.int64)
        root = ids.copy()
        root[np.searchsorted(ids, ea)] = eb
        keep = (links > 0) | (root != ids) | np.isin(ids, eb)
        return pa.table({"cls": ids[keep], "links": links[keep], "root": root[keep]})

    got = settle(grouped.groupBy("label", "region", "low", "high").applyInArrow(search, "cls long, links long, root long"), "links")
    joined = components(got.select("cls", "root"), "cls", "root")
    total = got.groupBy("cls").agg(F.sum("links").alias("links"))
    info = found.select("cls", "n", "first_id").join(total, "cls", "left").join(joined.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    info = settle(info.select("cls", "component", "first_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "class-links")
    least = info.groupBy("component").agg(F.min("first_id").alias("component_id"))
    info = info.join(least, "component").select("cls", "n_links", "component_id")
    linked = members.where("cls is not null").join(info, "cls").select("vec_id", "n_links", "component_id")
    alone = members.where("cls is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def audit(vectors: DataFrame, result: DataFrame, part: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", limit: float = 0.93, at_most: int = 4000) -> float:
    """Links found over links there are, of the rows whose id is divisible by `part` (of more than `at_most`, those first by a hash), each compared with all rows in blocks."""
    asked = vectors.where((F.col(id_col) % part == 0) & _valid(label_col, vector_col)).select(id_col, label_col, vector_col).orderBy(F.xxhash64(F.lit(29), id_col)).limit(at_most)
    asked = [(r[0], r[1], np.array(r[2], float)) for r in asked.collect()]
    by_label: dict = {}
    for i, label, v in asked:
        by_label.setdefault((label, len(v)), []).append((i, v))
    packed = {k: (np.array([i for i, _ in v]), unit(np.stack([x for _, x in v]))) for k, v in by_label.items()}

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            for label, part_ in batch.to_pandas().groupby("label"):
                lengths = part_["vector"].map(len)
                for size in lengths.unique():
                    if (label, size) in packed:
                        ids, q = packed[label, size]
                        rows = part_[lengths == size]
                        hit = (unit(np.stack(rows["vector"]).astype(float)) @ q.T >= limit).sum(0)
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hit.astype(np.int64))], ["vec_id", "hits"])

    rows = vectors.where(_valid(label_col, vector_col)).select(F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    truth = rows.mapInArrow(count, "vec_id long, hits long").groupBy("vec_id").agg((F.sum("hits") - 1).alias("truth"))
    sums = truth.join(result.select("vec_id", "n_links"), "vec_id").agg(F.sum(F.least("truth", "n_links")).alias("found"), F.sum("truth").alias("truth")).first()
    return 1.0 if not sums["truth"] else sums["found"] / sums["truth"]


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_links(table(spark, sf_dir, "embeddings"))
