"""Exact vector retrieval and the comparison of vector spaces."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from locusmith.functions.vectors import cosine, norm
from locusmith.plans.store import written

#: Queries that are multiplied with a batch of items at a time.
QUERY_BLOCK = 1024
#: Numbers of the query vectors up to which all of them are sent to every executor (64 MB).
SHARED_NUMBERS = 1 << 23
#: Items of one block where queries are more than can be sent.
ITEM_BLOCK = 1 << 16


def search(items: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k items nearest to one query: (key, distance), by cosine distance and then key. No full sort: each task keeps k rows."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    return items.select(key, (1 - cosine(F.col(vector), literal)).alias("distance")).orderBy("distance", key).limit(k)


class Nearest:
    """The k best items of every query among those seen so far: by score (12 digits), then key."""

    def __init__(self, names: np.ndarray, unit: np.ndarray, k: int, same: bool, block: int) -> None:
        self.names, self.unit, self.k, self.block = names, unit, k, block
        self.place = None if same else {name: i for i, name in enumerate(names.tolist())}
        self.scores = np.full((len(names), k), -np.inf)
        self.ids: np.ndarray | None = None

    def see(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        norms = np.linalg.norm(vectors, axis=1)
        order = np.flatnonzero(norms > 0)
        order = order[np.argsort(ids[order], kind="stable")]
        ids, units = ids[order], (vectors[order] / norms[order][:, None]).T
        if not len(ids):
            return
        if self.ids is None:
            self.ids = np.full((len(self.names), self.k), ids[0], dtype=ids.dtype)
        itself = {} if self.place is None else {c: self.place[i] for c, i in enumerate(ids.tolist()) if i in self.place}
        for at in range(0, len(self.names), self.block):
            scores = self.unit[at : at + self.block] @ units
            for column, query in itself.items():
                if at <= query < at + self.block:
                    scores[query - at, column] = -np.inf
            self.merge(at, np.round(scores, 12), ids)

    def merge(self, at: int, scores: np.ndarray, ids: np.ndarray) -> None:
        k, rows = self.k, np.arange(len(scores))[:, None]
        if scores.shape[1] > k:
            near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
            least = scores[rows, near].min(axis=1)
            for i in np.flatnonzero((scores >= least[:, None]).sum(axis=1) > k):  # equal scores on the border: the first by key, which ids are sorted by
                near[i] = np.lexsort((np.arange(scores.shape[1]), -scores[i]))[:k]
            scores, new = scores[rows, near], ids[near]
        else:
            new = np.broadcast_to(ids, scores.shape)
        end = at + len(scores)
        scores, both = np.hstack([self.scores[at:end], scores]), np.hstack([self.ids[at:end], new])
        keys = np.unique(both, return_inverse=True)[1].reshape(both.shape)
        best = np.lexsort((keys, -scores), axis=1)[:, :k]
        self.scores[at:end], self.ids[at:end] = scores[rows, best], both[rows, best]

    def frame(self, columns: list[str]) -> pd.DataFrame:
        if self.ids is None:
            return pd.DataFrame(columns=columns)
        query, place = np.nonzero(self.scores > -np.inf)
        return pd.DataFrame(dict(zip(columns, (self.names[query], self.ids[query, place], self.scores[query, place]), strict=True)))


def _stacked(vectors: pd.Series, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(which of the vectors have that size, these as a matrix)."""
    fits = np.array([v is not None and len(v) == size for v in vectors], dtype=bool)
    return fits, np.stack(vectors[fits].to_numpy()).astype(np.float64) if fits.any() else np.empty((0, size))


def top_k(items: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", same: bool = False, block: int = QUERY_BLOCK, shared: int = SHARED_NUMBERS) -> DataFrame:
    """(query, key, score, rank) of the k items nearest to each query of queries (query, vector), exactly.

    A stated query set against all rows: items are read once, each task multiplies its batches with all queries, block by block, and
    keeps a running top k, so k rows per query leave a task. The queries are counted first: up to `shared` numbers of them are sent to
    every executor; beyond, both sides are cut into blocks by hash and every pair of blocks is a task. The rows are the same. Ranks are by score
    (12 digits), then key. same: whether an item may find itself. Vectors that are null, of another size than the query's or of norm zero are no neighbours.
    """
    schema = StructType([StructField("query", queries.schema["query"].dataType), StructField(key, items.schema[key].dataType), StructField("score", DoubleType())])
    asked = queries.select("query", "vector").where("vector IS NOT NULL")
    facts = asked.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("size"), F.max(norm(F.col("vector")) == 0).alias("zero")).first()
    if not facts["n"]:
        return items.sparkSession.createDataFrame([], StructType([*schema.fields, StructField("rank", IntegerType())]))
    if facts["least"] != facts["size"]:
        raise ValueError("query vectors differ in size")
    if facts["zero"]:
        raise ValueError("a query vector of norm zero")
    size, columns = facts["size"], schema.names

    def nearest_of(names: pd.Series, vectors: pd.Series) -> Nearest:
        return Nearest(names.to_numpy(), _units(np.stack(vectors.to_numpy()).astype(np.float64)), k, same, block)

    if facts["n"] * size <= shared:
        sent = items.sparkSession.sparkContext.broadcast(asked.toPandas())

        def scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = nearest_of(sent.value["query"], sent.value["vector"])
            for batch in batches:
                fits, matrix = _stacked(batch[vector], size)
                best.see(batch[key].to_numpy()[fits], matrix)
            yield best.frame(columns)

        found = items.select(key, vector).mapInPandas(scan, schema)
    else:
        blocks = -(-facts["n"] // max(1, shared // size))
        parts = max(1, -(-items.count() // ITEM_BLOCK))
        numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = asked.withColumns({"_q": F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"), "_i": numbers(parts)})
        right = items.select(key, vector).withColumns({"_i": F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"), "_q": numbers(blocks)})

        def pair(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
            if one.empty or other.empty:
                return pd.DataFrame(columns=columns)
            best = nearest_of(one["query"], one["vector"])
            fits, matrix = _stacked(other[vector], size)
            best.see(other[key].to_numpy()[fits], matrix)
            return best.frame(columns)

        found = left.groupBy("_q", "_i").cogroup(right.groupBy("_q", "_i")).applyInPandas(pair, schema)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Probes of one block: each task compares one block of a group with another.
PROBE_BLOCK = 2048


def _nearest(queries: np.ndarray, items: np.ndarray, others: np.ndarray | None, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the distances (negative cosines) and places of the k nearest items, ties by place. others: which pairs count, all if None."""
    far = 0.0 - np.round(_units(queries) @ _units(items).T, 12)
    if others is not None:
        far[~others] = np.inf
    k = min(k, far.shape[1])
    least = np.partition(far, k - 1, axis=1)[:, k - 1]
    out = []
    for row, most in zip(far, least, strict=True):
        near = np.flatnonzero((row <= most) & (row < np.inf))
        near = near[np.argsort(row[near], kind="stable")][:k]
        out.append((row[near], near))
    return out


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def _compared(probes: DataFrame, k: int, by: str, single: bool, block: int) -> DataFrame:
    """(by, cosine, same, margin) of every probe that has others in its group, whatever the size of the group.

    Groups are cut into blocks by hashes of the ids and every pair of blocks is one task; the k + 1 nearest of a probe
    are the nearest of those found in the pairs.
    """
    rows = probes.select(F.col(by).cast("string").alias("_group"), "id", "reference", "exported")
    sizes = rows.groupBy(F.col("_group").alias("_size_of")).agg(F.count(F.lit(1)).alias("_n"))
    if single:
        sizes = sizes.withColumn("_n", F.when(F.col("_n") > k, F.col("_n")).otherwise(F.raise_error(F.lit("probes must be more than k")).cast("bigint")))
    blocks = F.ceil(F.col("_n") / block).cast("int")
    rows = rows.join(sizes, F.col("_group").eqNullSafe(F.col("_size_of"))).withColumn("_blocks", blocks)
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    kinds = ["_group", "id", "reference", "exported"]
    asking = rows.select(*kinds, F.lit(True).alias("_asks"), F.col("_own").alias("_q"), F.col("_other").alias("_i"))
    asked = rows.select(*kinds, F.lit(False).alias("_asks"), F.col("_other").alias("_q"), F.col("_own").alias("_i"))
    identity = probes.schema["id"].dataType
    numbers = ArrayType(DoubleType())
    schema = StructType([StructField("_group", StringType()), StructField("id", identity), StructField("cosine", DoubleType()), StructField("da", numbers), StructField("ia", ArrayType(identity)), StructField("db", numbers), StructField("ib", ArrayType(identity))])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        queries, items = pdf[pdf["_asks"]], pdf[~pdf["_asks"]].sort_values("id")
        if queries.empty or items.empty:
            return pd.DataFrame(columns=schema.names)
        at, of = queries["id"].to_numpy(), items["id"].to_numpy()
        same = pdf["_q"].iloc[0] == pdf["_i"].iloc[0]
        (a, b), (c, d) = ([np.stack(x[v].to_numpy()).astype(np.float64) for v in ("reference", "exported")] for x in (queries, items))
        others = at[:, None] != of[None, :] if same else None
        cosines = (_units(a) * _units(b)).sum(1) if same else [None] * len(at)
        near = [_nearest(x, y, others, k + 1) for x, y in ((a, c), (b, d))]
        found = {f"{what}{side}": [x[n] if what == "d" else of[x[1]] for x in lists] for side, lists in zip("ab", near, strict=True) for n, what in enumerate("di")}
        return pd.DataFrame({"_group": queries["_group"].to_numpy(), "id": at, "cosine": cosines, **found})[schema.names]

    pairs = asking.unionByName(asked).groupBy("_group", "_q", "_i").applyInPandas(compare, schema)
    best = [F.slice(F.sort_array(F.flatten(F.collect_list(F.arrays_zip(f"d{x}", f"i{x}")))), 1, k + 1).alias(x) for x in "ab"]
    merged = pairs.groupBy("_group", "id").agg(F.max("cosine").alias("cosine"), *best).where("size(a) > 0")
    falls = F.transform(F.sequence(F.lit(2), F.size("a")), lambda n: F.element_at("a", n)["da"] - F.element_at("a", n - 1)["da"])
    margin = F.when(F.size("a") > 1, F.array_min(falls))
    same = F.slice("a", 1, k)["ia"] == F.slice("b", 1, k)["ib"]
    return merged.select(F.col("_group").alias(by), "cosine", same.alias("same"), margin.alias("margin"))


def fidelity(probes: DataFrame, k: int, group: str | None = None, block: int = PROBE_BLOCK) -> DataFrame:
    """How well exported vectors stand for the reference ones, by group (or in all): probes (id, reference, exported).

    Mean and least cosine, perturbation (1 - mean cosine), share of probes whose k nearest others are the same in order, mean margin (the
    smallest gap among the similarities of the k + 1 nearest), and how many margins are below the perturbation. All are
    compared with all inside a group of any size, in blocks; ids are unique in their group. Without group, probes must be more than k. A group
    of at most k probes is measured over the others it has: two probes have no margin (null), and one alone, with nothing to be ranked, is not listed.
    """
    by = group or "_all"
    each = written(_compared(probes.withColumn("_all", F.lit("all")), k, by, group is None, block), "fidelity")
    means = each.groupBy(by).agg(F.count(F.lit(1)).alias("probes"), F.avg("cosine").alias("mean_cosine"), F.min("cosine").alias("min_cosine"), F.avg(F.col("same").cast("int")).alias("agreement"), F.avg("margin").alias("mean_margin"))
    means = means.withColumn("perturbation", 1 - F.col("mean_cosine"))
    near = means.select(F.col(by).alias("_by"), F.col("perturbation").alias("_perturbation"))
    below = each.join(near, F.col(by).eqNullSafe(F.col("_by"))).groupBy("_by").agg(F.count_if(F.col("margin") < F.col("_perturbation")).alias("margins_below"))
    out = means.join(below, F.col(by).eqNullSafe(F.col("_by"))).select(by, "probes", "mean_cosine", "min_cosine", "perturbation", "agreement", "mean_margin", "margins_below")
    return out if group else out.drop("_all")


def pending(chunks: DataFrame, embedded: DataFrame, model: str, key: str = "chunk_id") -> DataFrame:
    """Chunks without a vector of the model: what a resumed run still has to do."""
    return chunks.join(embedded.where(F.col("model") == model).select(key), key, "left_anti")


def embed_pending(chunks: DataFrame, embedded: Callable[[], DataFrame], encode: Callable[[list[str]], np.ndarray], model: str, dimensions: int, write: Callable[[DataFrame], None], corpus: Callable[[], str], rounds: int = 16) -> int:
    """Encodes the chunks (chunk_id, text) that lack a vector of the model, and returns how many there were.

    embedded reads the stored vectors (chunk_id, model); encode gives one vector per text of an Arrow batch, in the workers; write stores a
    frame (chunk_id, model, vector). Work is cut into rounds by hash and each is stored before the next begins, so a run that breaks off goes on where it
    was. corpus gives the hash of the corpus: one that changed meanwhile is an error, and so are vectors of another size, not finite or zero.
    """
    before = corpus()
    todo = pending(chunks.select("chunk_id", "text"), embedded(), model)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = np.asarray(encode(batch["text"].tolist()), dtype=np.float64)
            if vectors.shape != (len(batch), dimensions):
                raise ValueError("the encoder returned vectors of another number or size")
            if not np.isfinite(vectors).all() or not vectors.any(axis=1).all():
                raise ValueError("the encoder returned a vector that is not finite or zero")
            yield pd.DataFrame({"chunk_id": batch["chunk_id"], "model": model, "vector": list(vectors)})

    count = todo.count()
    identity = chunks.schema["chunk_id"].dataType.simpleString()
    for turn in range(min(rounds, count)):
        part = pending(chunks.select("chunk_id", "text"), embedded(), model).where(F.pmod(F.xxhash64("chunk_id"), F.lit(min(rounds, count))) == turn)
        write(part.mapInPandas(run, f"chunk_id {identity}, model string, vector array<double>"))
    if corpus() != before:
        raise ValueError("the corpus changed while it was embedded; run again before scoring")
    return count


def ranked_units(ranking: DataFrame, chunk_units: DataFrame, key: str = "chunk_id") -> DataFrame:
    """ranking with units, the locators each ranked chunk covers; an unknown chunk keeps its rank with an empty array."""
    return ranking.join(chunk_units.select(key, "units"), key, "left").withColumn("units", F.coalesce("units", F.array().cast("array<string>")))


def truncation_counts(texts: DataFrame, limit: int, by: str = "source_id") -> DataFrame:
    """Per source: passages, and those longer than limit tokens; tokens are a column of texts."""
    return texts.groupBy(by).agg(F.count(F.lit(1)).alias("passages"), F.count_if(F.col("tokens") > limit).alias("truncated"))
