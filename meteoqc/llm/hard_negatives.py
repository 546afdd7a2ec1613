"""Hard negatives: rows of other labels whose score is close below that of an anchor's positives.

Exact search in a multiway hyperplane tree (``hyperplane_tree``):

* Equal vectors of one label are one class with its smallest ids; no result can hold more of them.
  Anchors of one class ask once.
* The upper tree is grown on at most ``SAMPLE`` classes (those with the smallest hashes). Every row is
  placed in it, and its distance ranges are the minima and maxima over all rows, merged by Spark.
  Only the tree and the sample are sent to the tasks; both are bounded by their parameters.
* A query goes to the leaves that its annulus can meet. The sample gives it a first bound: as many
  rows as it wants are known to be at least that good.
* A leaf's rows and the queries that reach it meet in one task, as blocks of at most about ``BLOCK``
  rows and ``TURN`` queries; the task grows a tree of its own over the block and searches it.
* First the positives of every anchor are found, then, in windows that follow from their scores, the
  negatives. All windows of an anchor are searched together.

A score is the inner product of the vectors with components ``floor(256 x)``, exact in 64 bits. Rows
with a null label, id or vector, with a null or non-finite component, or with a component of 2^22 and
more after scaling (whose scores would not fit) take no part. Vectors of different lengths never meet.
Repeated ids are rows of their own: an anchor leaves out itself, not other rows with its id. Fewer
candidates give fewer rows, an anchor without positives or negatives gives none. Ties go to smaller
ids. Columns other than vec_id, embedding and label are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meteoqc.llm.common import staged, table
from meteoqc.llm.hyperplane_tree import LOWEST, Search, Tree, annulus, inner_products, lifted

POSITIVES, NEGATIVES = 5, 10
SAMPLE, UPPER_LEAF, BLOCK, TURN = 8192, 128, 8192, 16384
LARGEST = 1 << 22
TOP = 1 << 62
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
FOUND = "cid long, low long, high long, vec_id long, from long, score long"
ASKED = "cid long, label long, vector array<long>, low array<long>, high array<long>"


def usable(vectors: DataFrame, label: Column) -> DataFrame:
    """(vec_id, label, vector of longs) of the rows that take part."""
    v = F.col("vector")
    known = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    whole = known.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()).where(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST / 256)))
    return whole.withColumn("vector", F.transform(v, lambda x: F.floor(x * 256.0)))


def classes_of(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Every different (label, vector) once: its ``k`` smallest ids, and whether an anchor is among its rows."""
    place = F.row_number().over(Window.partitionBy("label", "vector").orderBy("vec_id"))
    few = rows.withColumn("place", place).where(F.col("place") <= k).groupBy("label", "vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = queries.select("label", "vector").distinct().withColumn("asked", F.lit(True))
    return few.join(asked, ["label", "vector"], "left").select(F.monotonically_increasing_id().alias("cid"), "label", "vector", "ids",
                                                               F.coalesce("asked", F.lit(False)).alias("asked"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def lists(column: pa.Array | pa.ChunkedArray, fill: int) -> np.ndarray:
    """A ragged column as a matrix."""
    rows = column.to_pylist()
    out = np.full((len(rows), max((len(r) for r in rows), default=0)), fill, np.int64)
    for k, r in enumerate(rows):
        out[k, :len(r)] = r
    return out


def ranges_of(classes: DataFrame, tree: Tree, reach2: float, width: int) -> Tree:
    """The tree with the distance ranges of all rows instead of the sample's."""
    tree.forget_ranges()
    held = classes.sparkSession.sparkContext.broadcast(tree)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        own.forget_ranges()  # a worker keeps the broadcast over tasks
        for b in batches:
            if b.num_rows:
                own.place(lifted(matrix(b.column(0), width), reach2), widen=True)
        out = [(n, i, j, node.low[i, j], node.high[i, j]) for n, node in enumerate(own.nodes)
               for i in range(len(node.points)) for j in range(len(node.points)) if node.low[i, j] <= node.high[i, j]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["node", "i", "j", "low", "high"])

    parts = classes.select("vector").mapInArrow(measure, "node long, i long, j long, low double, high double")
    for r in parts.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():  # the tree's size at most
        tree.nodes[r.node].low[r.i, r.j], tree.nodes[r.node].high[r.i, r.j] = r.low, r.high
    held.unpersist()
    return tree


class Index:
    """Classes of one vector length, placed in the leaves of an upper tree."""

    def __init__(self, classes: DataFrame, width: int, sample: int = SAMPLE, block: int = BLOCK, turn: int = TURN):
        self.spark, self.width, self.turn = classes.sparkSession, width, turn
        square = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x * x)
        self.reach2 = reach2 = float(classes.agg(F.max(square)).first()[0] or 0)
        some = classes.orderBy(F.xxhash64("vector", "label"), "cid").limit(sample).select("vector", "label").toArrow()
        known = matrix(some["vector"], width), some["label"].to_numpy()
        tree = ranges_of(classes, Tree(lifted(known[0], reach2), UPPER_LEAF), reach2, width)
        self.held = held = self.spark.sparkContext.broadcast((tree, *known))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                leaf = held.value[0].place(lifted(matrix(b.column(1), width), reach2)) if b.num_rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int64())], names=[*b.schema.names, "leaf"])

        self.rows = staged(classes.select("cid", "vector", "label", "ids").mapInArrow(place, "cid long, vector array<long>, label long, ids array<long>, leaf long"))
        size = dict(self.rows.groupBy("leaf").count().collect())  # leaves of the sample's tree at most
        self.salts = F.array(*[F.lit(max(1, -(-size.get(k, 0) // block))) for k in range(len(tree.members))])

    def search(self, asked: DataFrame, same: bool, k: int) -> DataFrame:
        """The best ``k`` rows in each window of ``asked``: cid of the query, window, id and class of the row, score."""
        held, reach2, width = self.held, self.reach2, self.width

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, known, known_labels = held.value
            slack = 1e-6 * (1.0 + np.sqrt(reach2))
            for batch in batches:
                for b in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                    label, q, low, high = b.column(1).to_numpy(), matrix(b.column(2), width), lists(b.column(3), 1), lists(b.column(4), 0)
                    scores = inner_products(q, known)
                    fits = (known_labels[None] == label[:, None]) == same
                    for w in range(low.shape[1]):
                        inside = np.where(fits & (scores >= low[:, w][:, None]) & (scores <= high[:, w][:, None]), scores, LOWEST)
                        if inside.shape[1] >= k:
                            bound = np.partition(inside, inside.shape[1] - k, axis=1)[:, -k]
                            low[:, w] = np.maximum(low[:, w], bound)
                    near, far = annulus(q, low, high, reach2, slack)
                    reached = tree.reached(np.column_stack([q, np.zeros(len(q))]), near, far)
                    who, leaf = np.nonzero(reached & (low <= high).any(1)[:, None])
                    if len(who):
                        sent = b.take(pa.array(who))
                        bounds = pa.array(low[who].tolist(), pa.list_(pa.int64())), pa.array(high[who].tolist(), pa.list_(pa.int64()))
                        first = sent.column(3)
                        yield pa.RecordBatch.from_arrays([sent.column(0), sent.column(1), sent.column(2), first, *bounds, pa.array(leaf, pa.int64())],
                                                         names=["cid", "label", "vector", "asked_low", "low", "high", "leaf"])

        routed = staged(asked.select("cid", "label", "vector", "low", "high").mapInArrow(
            route, "cid long, label long, vector array<long>, asked_low array<long>, low array<long>, high array<long>, leaf long"))
        wanted = dict(routed.groupBy("leaf").count().collect())
        turns = {leaf: max(1, -(-n // self.turn)) for leaf, n in wanted.items()}
        if not turns:
            return self.spark.createDataFrame([], FOUND)
        turn_of = F.array(*[F.lit(turns.get(leaf, 0)) for leaf in range(max(turns) + 1)])
        in_turns = F.coalesce(F.try_element_at(turn_of, (F.col("leaf") + 1).cast("int")), F.lit(0))
        salts = F.element_at(self.salts, (F.col("leaf") + 1).cast("int"))
        index = self.rows.withColumn("salt", F.pmod(F.xxhash64("cid"), salts).cast("int")).withColumn("turns", in_turns).where("turns > 0").withColumn(
            "turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
        queries = routed.withColumn("turn", F.pmod(F.xxhash64("cid"), in_turns).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        key = ["leaf", "salt", "turn"]
        hits = index.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(_searching(same, k, reach2, width), FOUND)
        place = F.row_number().over(Window.partitionBy("cid", "low", "high").orderBy(F.desc("score"), "vec_id", "from"))
        return hits.withColumn("place", place).where(F.col("place") <= k).drop("place")


def _searching(same: bool, k: int, reach2: float, width: int) -> Callable:
    def search(_, index: pa.Table, asked: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 6
        if index.num_rows and asked.num_rows:
            low, high, window = lists(asked["low"], 1), lists(asked["high"], 0), lists(asked["asked_low"], 0)
            own = Search(matrix(index["vector"], width), index["label"].to_numpy(), reach2)
            who, w, row, score = own.best(matrix(asked["vector"], width), asked["label"].to_numpy(), same, low, high, k)
            ids = index["ids"].to_pylist()
            times = np.array([len(i) for i in ids])[row] if len(row) else np.zeros(0, np.int64)
            vec = np.array([v for r in row.tolist() for v in ids[r]], np.int64)
            who, w, score, source = (np.repeat(x, times) for x in (who, w, score, index["cid"].to_numpy()[row]))
            order = np.lexsort((source, vec, -score, w, who))
            who, w, score, source, vec = who[order], w[order], score[order], source[order], vec[order]
            first = np.maximum.accumulate(np.where(np.concatenate([[True], (who[1:] != who[:-1]) | (w[1:] != w[:-1])])[:len(who)], np.arange(len(who)), 0))
            best = np.arange(len(who)) - first < k
            who, w = who[best], w[best]
            out = [asked["cid"].to_numpy()[who], window[who, w], high[who, w], vec[best], source[best], score[best]]
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["cid", "low", "high", "vec_id", "from", "score"])

    return search


def hard_negatives(vectors: DataFrame, anchors: Column, label: Column, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES,
                   sample: int = SAMPLE, block: int = BLOCK, turn: int = TURN) -> DataFrame:
    """Negatives of every anchor and positive whose score is 0.3 to 0.9 of the positive's.

    ``vectors`` holds (vec_id, embedding, and what ``label`` reads); ``anchors`` is a condition on vec_id.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, label)
    asking = rows.where(anchors)
    classes = staged(classes_of(rows, asking, max(n_positives + 1, n_negatives)))
    asking = staged(asking.join(classes.where("asked").select("cid", "label", "vector"), ["label", "vector"]).select("vec_id", "cid"))
    out = spark.createDataFrame([], RESULT)
    for r in classes.groupBy(F.size("vector").alias("n")).count().collect():  # one row for each vector length
        own = classes.where(F.size("vector") == r.n)
        index = Index(own, r.n, sample, block, turn)
        out = out.unionByName(_mine(index, own.where("asked"), asking, n_positives, n_negatives))
    return out


def _mine(index: Index, queries: DataFrame, asking: DataFrame, n_positives: int, n_negatives: int) -> DataFrame:
    everything = queries.select("cid", "label", "vector", F.array(F.lit(-TOP)).alias("low"), F.array(F.lit(TOP)).alias("high"))
    # one more than wanted, since an anchor may find itself
    near = staged(index.search(everything, True, n_positives + 1).groupBy("cid").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("fall"), "vec_id", "from"))).alias("near")))
    # 10 times a negative lies between 3 and 9 times its positive
    tenth, rest = F.expr("score div 10"), F.expr("score % 10")
    windows = near.select("cid", F.explode("near").alias("p")).select("cid", (-F.col("p.fall")).alias("score")).distinct().where("score >= 0").select(
        "cid", "score", (tenth * 3 + F.ceil(rest * 3 / 10)).alias("low"), (tenth * 9 + F.floor(rest * 9 / 10)).alias("high"))
    windows = staged(windows.where("low <= high"))
    asked = queries.select("cid", "label", "vector").join(windows.groupBy("cid").agg(
        F.array_sort(F.collect_set(F.struct("low", "high"))).alias("w")), "cid").select("cid", "label", "vector", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    found = index.search(asked, False, n_negatives).groupBy("cid", "low", "high").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("fall"), "vec_id", "from"))).alias("far"))
    found = windows.join(found, ["cid", "low", "high"]).select("cid", "score", "far")
    self_at = F.array_position(F.transform("near", lambda p: F.struct(p["vec_id"], p["from"])), F.struct("vec_id", F.col("cid").alias("from"))) - 1
    kept = F.slice(F.filter("near", lambda p, i: i != self_at), 1, n_positives)
    pairs = asking.join(near, "cid").select(F.col("vec_id").alias("anchor_id"), "cid", F.explode(kept).alias("p")).select(
        "anchor_id", "cid", F.col("p.vec_id").alias("positive_id"), (-F.col("p.fall")).alias("score"))
    return pairs.join(found, ["cid", "score"]).select("anchor_id", "positive_id", "score", F.posexplode("far").alias("k", "n")).select(
        "anchor_id", "positive_id", (F.col("k") + 1).alias("rank"), F.col("n.vec_id").alias("negative_id"), F.col("score").alias("positive_score"),
        (-F.col("n.fall")).alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS c
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_dot_product(a.c, v.c)::BIGINT AS score
  FROM v AS a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY rank <= 10
"""
