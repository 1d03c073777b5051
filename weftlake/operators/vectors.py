"""Vector search, centroids, nearest neighbours and cluster reports."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlake.session import counted, cut

#: Vectors of a block of queries: 16 MB at 512 dimensions, whatever the number of queries.
QUERY_BLOCK = 4096


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product of two arrays, in doubles, in index order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: str | Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: str) -> Column:
    """The unit vector; null for a zero or non-finite one."""
    n = norm(v)
    ok = (n > 0) & (n < float("inf")) & ~F.isnan(n)
    return F.when(ok, F.transform(v, lambda x: x.cast("double") / n))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, none of them null, as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by the smaller id; rows with -inf never count."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero((scores >= least) & (scores > -np.inf))
    else:
        at = np.flatnonzero(scores > -np.inf)
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def scored(queries: DataFrame, rows: DataFrame, k: int | None, least: float = -np.inf, drop_self: bool = False, digits: int = 9, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, score) by inner product of queries and rows (id, vector): of each query and task the k best
    (None: all) of at least `least`. Null vectors are left out.

    Queries are read in blocks of bounded size, each of which meets all rows where they are; rows are
    never shuffled and pairs below the bounds never leave a task. With more than one block each
    block's result is written before the next one is read.
    """
    kinds = [queries.schema["id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()]
    schema = f"query_id {kinds[0]}, id {kinds[1]}, score double"
    given = rows.filter("vector IS NOT NULL").select("id", "vector")

    def against(qid: np.ndarray, q: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: list[list] = [[np.empty(0, qid.dtype), np.empty(0)] for _ in qid]
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = batch.column("id").to_numpy(zero_copy_only=False)
                s = np.round(q @ _matrix(batch.column("vector")).T, digits)
                if drop_self:
                    s[qid[:, None] == ids[None, :]] = -np.inf
                s[s < least] = -np.inf
                for i in range(len(qid)):
                    here = best_of(s[i], ids, k if k is not None else s.shape[1])
                    names, points = np.concatenate([found[i][0], ids[here]]), np.concatenate([found[i][1], s[i][here]])
                    if k is not None and len(names) > k:
                        here = best_of(points, names, k)
                        names, points = names[here], points[here]
                    found[i] = [names, points]
            sizes = [len(f[0]) for f in found]
            if sum(sizes):
                cols = [np.repeat(qid, sizes), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "id", "score"]).cast(target)

        return given.mapInArrow(run, schema)

    to_arrow = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    target = pa.schema([("query_id", to_arrow[kinds[0]]), ("id", to_arrow[kinds[1]]), ("score", pa.float64())])
    held = queries.filter("vector IS NOT NULL").select("id", "vector").toLocalIterator()
    out, part = None, list(islice(held, block))
    while part:
        one = against(np.array([r["id"] for r in part]), np.array([r["vector"] for r in part], dtype=np.float64))
        part = list(islice(held, block))
        if out is not None or part:
            one = cut(one, "scored")
        out = one if out is None else out.union(one)
    return out if out is not None else queries.sparkSession.createDataFrame([], schema)


def top_k(queries: DataFrame, rows: DataFrame, k: int, drop_self: bool = False) -> DataFrame:
    """Exact k nearest rows by inner product of each query (id, vector), ties by id. The
    query set is stated by the caller; k rows a query and task are shuffled, never the pairs."""
    best = scored(queries, rows, k, drop_self=drop_self)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(query: list[float], rows: DataFrame, k: int, floor: float = 0.0, keep: Column | None = None) -> DataFrame:
    """Filters and the score floor go before the top k, which is a distributed top-k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    out = (rows.filter(keep) if keep is not None else rows).withColumn("score", F.round(dot(q, F.col("vector")), 6))
    return out.filter(F.col("score") >= floor).orderBy(F.desc("score"), "id").limit(k)


def centroids(rows: DataFrame, label: str = "label") -> DataFrame:
    """The unit vector of the sum of a label's vectors. Sums are by position, combined before the
    shuffle, so a hot label does not meet in one task."""
    parts = rows.select(label, F.posexplode("vector").alias("pos", "x")).groupBy(label, "pos").agg(F.round(F.sum(F.col("x").cast("double")), 9).alias("x"))
    vec = parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector"))
    return vec.select(label, unit("vector").alias("vector"))


def nearest(rows: DataFrame, cents: DataFrame, k: int, min_sim: float) -> DataFrame:
    """The k nearest centroids at least min_sim near, ties by label: (id, topic, sim, rank). A row's
    similarities stay in its task: centroids come in blocks, and only k of a row and block leave."""
    c = cents.select(F.col("label").alias("id"), "vector")
    kind, topic = rows.schema["id"].dataType.simpleString(), c.schema["id"].dataType.simpleString()
    given = rows.filter("vector IS NOT NULL").select("id", "vector")

    def against(labels: np.ndarray, q: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("id")
                s = np.round(_matrix(batch.column("vector")) @ q.T, 6) if len(ids) else np.empty((0, len(labels)))
                s[s < min_sim] = -np.inf
                each = [best_of(x, labels, k) for x in s]
                which = np.repeat(np.arange(len(ids)), [len(e) for e in each])
                at = np.concatenate([*each, np.empty(0, dtype=np.int64)])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(which)), pa.array(labels[at]).cast(to_arrow), pa.array(s[which, at])], ["id", "topic", "sim"])

        return given.mapInArrow(run, f"id {kind}, topic {topic}, sim double")

    to_arrow = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[topic]
    held = c.filter("vector IS NOT NULL").orderBy("id").toLocalIterator()
    out = None
    while part := list(islice(held, QUERY_BLOCK)):
        one = against(np.array([r["id"] for r in part]), np.array([r["vector"] for r in part], dtype=np.float64))
        out = one if out is None else out.union(one)
    if out is None:
        return rows.sparkSession.createDataFrame([], f"id {kind}, topic {topic}, sim double, rank int")
    w = Window.partitionBy("id").orderBy(F.desc("sim"), "topic")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest_or_noise(rows: DataFrame, cents: DataFrame, min_sim: float) -> DataFrame:
    """The nearest centroid, -1 if none is near enough."""
    best = nearest(rows, cents, 1, min_sim).select("id", "topic")
    return rows.select("id").join(best, "id", "left").select("id", F.coalesce("topic", F.lit(-1)).alias("cluster"))


def knn_links(rows: DataFrame, k: int = 2, top: int = 200) -> DataFrame:
    """Undirected edges to the k nearest rows of each, positive weights, the strongest `top`."""
    near = top_k(rows, rows, k, drop_self=True).filter("score > 0")
    e = near.select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b"), F.round("score", 6).alias("weight"))
    return e.groupBy("a", "b").agg(F.max("weight").alias("weight")).orderBy(F.desc("weight"), "a", "b").limit(top)


def semantic_gaps(cents: DataFrame, counts: DataFrame, together: DataFrame, min_sim: float = 0.45, min_each: int = 60, max_rate: float = 0.2, limit: int = 10) -> DataFrame:
    """Topics whose centroids are near but that rarely occur together:
    sim * (1 - co / min) * (1/2 + 1/2 min / max). Centroids and counts are one row a topic."""
    t = cut(cents.join(counts, "label").filter(F.col("n") >= min_each).select(F.col("label").alias("id"), "vector", "n"), "topics")
    pairs = scored(t, t, None, min_sim, digits=6).select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.col("score").alias("sim")).filter("a < b")
    for x in "ab":
        pairs = pairs.join(t.select(F.col("id").alias(x), F.col("n").alias(f"n{x}")), x)
    pairs = pairs.join(together, ["a", "b"], "left").withColumn("co", F.coalesce("co", F.lit(0)))
    small, big = F.least("na", "nb"), F.greatest("na", "nb")
    rate = F.col("co") / small
    score = F.round(F.col("sim") * (1 - rate) * (0.5 + 0.5 * small / big), 6)
    return pairs.filter(rate <= max_rate).select("a", "b", "sim", "co", score.alias("score")).orderBy(F.desc("score"), "a", "b").limit(limit)


def density_gaps(cents: DataFrame, counts: DataFrame, min_sim: float = 0.45, neighbours: int = 3, min_neighbour: int = 300, max_ratio: float = 0.5, limit: int = 10) -> DataFrame:
    """Thin topics beside busy ones: mean sim * (demand - own) / demand, demand the mean count of
    the nearest neighbours."""
    t = cut(cents.join(counts, "label").select(F.col("label").alias("id"), "vector", "n"), "topics")
    pairs = scored(t, t, neighbours, min_sim, drop_self=True, digits=6).select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.col("score").alias("sim"))
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    near = pairs.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= neighbours)
    for x in "ab":
        near = near.join(t.select(F.col("id").alias(x), F.col("n").alias(f"n{x}")), x)
    g = near.groupBy("a", "na").agg(F.avg("sim").alias("s"), F.avg("nb").alias("demand"))
    score = F.round(F.col("s") * (F.col("demand") - F.col("na")) / F.col("demand"), 6)
    return g.filter((F.col("demand") >= min_neighbour) & (F.col("na") <= max_ratio * F.col("demand"))).select(F.col("a").alias("topic"), F.round("demand", 6).alias("demand"), score.alias("score")).orderBy(F.desc("score"), "topic").limit(limit)


def cluster_summary(rows: DataFrame, label: str = "label") -> DataFrame:
    """Size of each cluster and the mean of its vectors' first three coordinates."""
    mean = [F.round(F.avg(F.get("vector", i).cast("double")), 6).alias(c) for i, c in enumerate("xyz")]
    return rows.groupBy(label).agg(F.count("*").alias("size"), *mean)


def ctfidf(terms: DataFrame, top: int) -> DataFrame:
    """C-TF-IDF keywords of (cluster, term) rows: tf / cluster size * ln(1 + mean size / total tf)."""
    tf = terms.groupBy("cluster", "term").agg(F.count("*").alias("tf"))
    size = tf.groupBy("cluster").agg(F.sum("tf").alias("size"))
    total = tf.groupBy("term").agg(F.sum("tf").alias("total"))
    mean = size.agg(F.avg("size").alias("mean"))
    s = F.round(F.col("tf") / F.col("size") * F.log(1 + F.col("mean") / F.col("total")), 6)
    rows = tf.join(size, "cluster").join(total, "term").crossJoin(F.broadcast(mean)).withColumn("score", s)
    w = Window.partitionBy("cluster").orderBy(F.desc("score"), "term")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("cluster", "term", "score", "rank")


def signature(vector: str) -> Column:
    """A hash of a vector, for change detection."""
    return F.sha1(F.to_json(vector))


def changed(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """Rows that are new or whose signature differs from the placed one (id, signature)."""
    return rows.withColumn("signature", signature("vector")).join(placed.select("id", "signature"), ["id", "signature"], "left_anti")


def k_for(n: int) -> int:
    """V08."""
    return int(min(8, max(2, round((n / 2) ** 0.5))))


def kmeans(rows: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """MLlib k-means: id, cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = rows.select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=25).fit(x).transform(x).select("id", F.col("prediction").alias("cluster"))


def pca_basis(rows: DataFrame) -> dict:
    """A frozen basis: the mean, the first three components (zero where the data have fewer) and the
    root mean square of all coordinates. Moments are summed over all rows by the engine; only a matrix of
    dimension x dimension reaches the driver. A component's largest entry is positive."""
    given = rows.filter("vector IS NOT NULL").select(F.col("vector").cast("array<double>").alias("vector"))

    def sums(batches):
        n, total, square = 0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("vector"))
                n, total, square = n + len(x), total + x.sum(axis=0), square + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()]), pa.array([square.ravel().tolist()])], ["n", "total", "square"])

    n, total, square = 0, 0.0, 0.0
    for r in given.mapInArrow(sums, "n long, total array<double>, square array<double>").toLocalIterator():  # one row a task
        n, total, square = n + r["n"], total + np.array(r["total"]), square + np.array(r["square"])
    if not n:
        return {"mean": [], "components": [], "scale": 1.0}
    mean = total / n
    spread = square.reshape(len(mean), -1) / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(spread)
    found = min(3, n, len(mean))
    components, kept = np.zeros((3, len(mean))), 0.0
    for i in range(found):
        v = vectors[:, -1 - i]
        components[i] = v * np.sign(v[np.argmax(np.abs(v))])
        kept += max(values[-1 - i], 0.0)
    scale = float(np.sqrt(kept / 3))
    return {"mean": mean.tolist(), "components": components.tolist(), "scale": scale if scale >= 1e-8 else 1.0}


def project(rows: DataFrame, basis: dict) -> DataFrame:
    """(id, x, y, z): coordinates in a frozen basis, over its scale; the basis holds for later rows too."""
    centred = F.zip_with(F.col("vector").cast("array<double>"), F.array(*[F.lit(x) for x in basis["mean"]]), lambda v, m: v - m)
    axes = [(dot("_c", F.array(*[F.lit(x) for x in c])) / F.lit(basis["scale"])).alias(a) for a, c in zip("xyz", basis["components"])]
    return rows.select("id", centred.alias("_c")).select("id", *axes)


def pca3(rows: DataFrame) -> DataFrame:
    """Rows in their own basis: centred, with unit root mean square over all coordinates."""
    return project(rows, pca_basis(rows))


def hash_embed(texts: DataFrame, dim: int = 64) -> DataFrame:
    """(id, pos, value) of the unit hash embedding: tokens are the letters and digits, of any script, of
    lower-cased white-space words, each counted at md5(token) mod dim, for dim a power of two up to 2^28.
    A text without a token has no row (the zero vector). A document is embedded in its own row."""
    if dim < 1 or dim & (dim - 1) or dim > 1 << 28:
        raise ValueError("dim must be a power of two up to 2^28")
    tok = F.filter(F.transform(F.split(F.lower("text"), r"(?U)\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", "")), lambda w: w != "")
    # Of a power of two only the last bits of the digest count.
    pos = lambda w: F.conv(F.substring(F.md5(w), -7, 7), 16, 10).cast("int") % dim
    c = texts.select("id", F.explode(F.transform(tok, pos)).alias("pos")).groupBy("id", "pos").agg(F.count("*").alias("c"))
    n = c.groupBy("id").agg(F.sqrt(F.sum(F.col("c") * F.col("c")).cast("double")).alias("n"))
    return c.join(n, "id").select("id", "pos", F.round(F.col("c") / F.col("n"), 6).alias("value"))


def attach_scores(graph: DataFrame, scores: DataFrame) -> DataFrame:
    """Graph rows with the emerging score of their colour, 0 where it has none."""
    s = scores.select(F.col("colour").alias("_colour"), F.col("score").alias("emerging_score"))
    return graph.join(s, F.col("colour") == F.col("_colour"), "left").drop("_colour").na.fill({"emerging_score": 0.0})


def one_model(rows: DataFrame, model: str, column: str = "model") -> DataFrame:
    """The rows of one vector space: those of the model, or (legacy) without a label."""
    return rows.filter(F.col(column).isNull() | (F.col(column) == model))


def to_index(papers: DataFrame, held: DataFrame, model: str, size: int | None = None) -> DataFrame:
    """Papers (id, text) that are to be indexed: with a text, and not held under this model; at most
    as many as the index has room for (size, its cap), the smallest ids first. A held row of another
    model raises, as vector spaces must not mix."""
    other = held.filter(F.col("model").isNotNull() & (F.col("model") != model))
    if not other.isEmpty():
        raise ValueError(f"the index holds vectors of another model than {model}")
    new = papers.filter("text IS NOT NULL AND trim(text) <> ''").join(held.select("id"), "id", "left_anti")
    return new if size is None else new.orderBy("id").limit(max(0, size - held.count()))


def public_rows(layout: DataFrame, labels: DataFrame) -> DataFrame:
    """What a layout shows: unclustered rows (-1) have no label and colour -1; a cluster without a label is
    named by its number, one without a colour has its number."""
    kept = layout.join(labels.select("cluster", "label", "colour"), "cluster", "left")
    own = F.col("cluster") >= 0
    return kept.select("id", "cluster", F.when(own, F.coalesce("label", F.concat(F.lit("Cluster "), F.col("cluster").cast("string")))).alias("label"), F.when(own, F.coalesce("colour", "cluster")).otherwise(-1).alias("colour"))


def needs_refit(basis: dict | None, dim: int) -> bool:
    """Whether a layout has to be fitted anew: no basis yet, or one of another dimension."""
    return not basis or len(basis.get("mean") or ()) != dim


def hungarian(cost: list[list[float]]) -> list[int]:
    """Minimum-cost column of each row (rows <= columns), for tens of clusters: successive
    shortest augmenting paths with potentials."""
    n, m = len(cost), len(cost[0]) if cost else 0
    row_p, col_p, owner = [0.0] * n, [0.0] * m, [-1] * m
    for start in range(n):
        dist, via, done = [float("inf")] * m, [-1] * m, [False] * m
        row, col = start, -1
        base = 0.0
        while True:
            best, nxt = float("inf"), -1
            for j in range(m):
                if not done[j]:
                    d = base + cost[row][j] - row_p[row] - col_p[j]
                    if d < dist[j]:
                        dist[j], via[j] = d, col
                    if dist[j] < best:
                        best, nxt = dist[j], j
            done[nxt], base, col = True, best, nxt
            if owner[col] < 0:
                break
            row = owner[col]
        for j in range(m):
            if done[j]:
                shift = base - dist[j]
                if j != col:
                    row_p[owner[j]] += shift
                col_p[j] -= shift
        row_p[start] += base
        while col >= 0:
            back = via[col]
            owner[col] = owner[back] if back >= 0 else start
            col = back
    out = [-1] * n
    for j, i in enumerate(owner):
        if i >= 0:
            out[i] = j
    return out


def match_colours(old: list[list[float]], new: list[list[float]], least: float = 0.5) -> list[int]:
    """For each new centroid the old one it continues (cosine at least `least`), else -1."""
    if not old or not new:
        return [-1] * len(new)
    a, b = np.array(new, dtype=float), np.array(old, dtype=float)
    cos = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    flip = len(new) > len(old)
    pick = hungarian((-(cos.T if flip else cos)).tolist())
    pairs = [(j, i) for i, j in enumerate(pick)] if flip else list(enumerate(pick))
    out = [-1] * len(new)
    for i, j in pairs:
        if cos[i, j] >= least:
            out[i] = j
    return out
