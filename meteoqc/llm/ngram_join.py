"""Near-duplicate documents: Jaccard join of word 5-gram sets with signature trees.

Two documents are linked when their sets of ``GRAM``-word shingles have a Jaccard similarity of 0.8
or more; the result names every document's connected component. Nothing is lost on the way:

1. A merged sketch (``Sketch``, its cells follow the bytes of text) tells which shingles can occur in
   two documents. A document in which more shingles than a link allows are its own cannot be linked
   and drops out. A second sketch does the same among the documents and shingles that the first one
   left, and so undoes most of what the first one wrongly took for shared.
2. Documents with equal sets become one. A tally counts the shingles of those sets. Sets that may be
   linked share one of a few shingles of either (the prefix of its set in an order that puts rare
   shingles first, so that a passage which many documents hold connects only those that consist of
   it). Sharing one, over any number of steps, makes documents a *family*; links never leave a family.
3. Families go to signature trees (``signature_tree``), small ones packed together, one task for a
   bounded number of documents. A family of more than ``BLOCK`` documents is cut into blocks by size: blocks
   are joined within themselves, then all documents are compared with pivots from the largest
   component so far, and at last the documents that are still outside the largest component meet
   all blocks of like sizes. A group of copies, however large, is thus connected in a few passes over it; only
   documents outside of it see the whole family.

Sets are compared by 64-bit hashes of shingles. A text with fewer words than ``GRAM`` has one
shingle, its whole sequence; one without words (or null) has none and is linked with nothing. Rows
that share a ``doc_id`` (or have none) are documents of their own; a component is named by the
smallest ``doc_id`` in it. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meteoqc.llm import anchors
from meteoqc.llm.common import keyed, slices, staged, table
from meteoqc.llm.signature_tree import PERCENT, Tree, links
from meteoqc.llm.sketch import SENT, Merged, Sketch, sized
from meteoqc.llm.window_dedup import Words

GRAM, BLOCK, PACK, PIVOTS = 5, 1024, 600, 3
#: bytes of text for each cell of the first sketch; a shingle takes about seven
CELL_BYTES = 5
#: shingles that a task holds before it sends their cells: more for a larger sketch, so that their differences stay as short
FLUSH, MOST_FLUSH = 500_000, 4_000_000
#: shingles that are looked up at a time in a sketch too large to be held
LOOK_UP = 2_000_000
#: large families whose pivots (one set each) may be broadcast
BROADCAST_PIVOTS = 5_000
#: rows of (family, band) that may be broadcast
BROADCAST_BANDS = 200_000
#: row numbers that may be broadcast, so that the token lists beside which they are looked up stay where they are
BROADCAST_ROWS = 1_000_000
#: ratio of sizes within a band, and bands between the sizes of a link: 1.1 ** 3 > 100 / PERCENT
BAND, BANDS = 1.1, 3
SETS = "row long, n long, k1 long, k2 long, tokens array<long>"
PREFIXES = "row long, n long, tokens array<long>, keys array<long>"


def shingle_sets(documents: list[bytes], gram: int = GRAM) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    words = Words([d.lower() for d in documents])
    symbols = words.symbols()
    all_, out = anchors.gram_hashes(symbols, gram), []
    for a, b in zip(words.borders[:-1].tolist(), words.borders[1:].tolist()):
        if b - a >= gram:
            out.append(np.unique(all_[a:b - gram + 1]))
        elif b > a:
            out.append(anchors.gram_hashes(symbols[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def allowed(n: int) -> int:
    """How many tokens of a set of ``n`` its prefix has: one more than a linked set may lack."""
    return n - -(-PERCENT * n // 100) + 1


def _sets(batch: pa.RecordBatch, gram: int) -> list[np.ndarray]:
    return shingle_sets([(x or "").encode() for x in batch.column(batch.schema.get_field_index("text")).to_pylist()], gram)


def shared_tokens(sets: list[np.ndarray], levels: list[tuple[Sketch, Merged]]) -> list[np.ndarray | None]:
    """Tokens of each set that every level takes for shared; None for sets that cannot be linked."""
    left: list[np.ndarray | None] = [s if len(s) else None for s in sets]
    for sketch, bits in levels:
        at = [i for i, s in enumerate(left) if s is not None]
        if not at:
            break
        mask = sketch.repeated(bits, np.concatenate([left[i] for i in at]))
        start = 0
        for i in at:
            kept = left[i][mask[start:start + len(left[i])]]
            start += len(left[i])
            left[i] = kept if allowed(len(sets[i])) > len(sets[i]) - len(kept) else None
    return left


def sketches_for(text: DataFrame) -> tuple[Sketch, Sketch]:
    """Sketches of about as many cells as ``text`` has shingles, and half as many for those that the first one leaves."""
    cells = (text.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // CELL_BYTES
    return sized(cells), sized(cells // 2)


def _flush(sketch: Sketch) -> int:
    return min(max(FLUSH, sketch.cells >> 9), MOST_FLUSH)


def _grouped(batches: Iterator[pa.RecordBatch], held: list, gram: int) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Slices of the batches with their sets; several at a time where a lookup walks through a large sketch."""
    most = LOOK_UP if any(merged.large for _, merged in held) else 0
    group: list[pa.RecordBatch] = []
    sets: list[np.ndarray] = []
    n = 0
    for b in slices(batches, "text"):
        more = _sets(b, gram)
        group, sets, n = [*group, b], sets + more, n + sum(map(len, more))
        if n >= most:
            yield group, sets
            group, sets, n = [], [], 0
    if group:
        yield group, sets


def _sketching(sketch: Sketch, held: list, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def send(batches):
        kept: list[np.ndarray] = []
        n = 0
        for _, sets in _grouped(batches, held, gram):
            more = [s for s in shared_tokens(sets, held) if s is not None]
            kept, n = kept + more, n + sum(map(len, more))
            if n > _flush(sketch):
                yield from sketch.touched(np.concatenate(kept))
                kept, n = [], 0
        if kept:
            yield from sketch.touched(np.concatenate(kept))

    return send


def _reading(held: list, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sizes of all sets; hashes and shared tokens of those that may be linked."""
    def read(batches):
        for group, sets in _grouped(batches, held, gram):
            rows: list[tuple] = []
            for s, kept in zip(sets, shared_tokens(sets, held)):
                if kept is None:
                    rows.append((len(s), None, None, None))
                    continue
                k1, k2 = (int(np.bitwise_xor.reduce(anchors.mixed(s ^ x)).view(np.int64)) for x in (anchors.BASE, anchors.MIX))
                rows.append((len(s), k1, k2, kept.view(np.int64)))
            n, k1, k2, tokens = zip(*rows)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([b.column(b.schema.get_field_index("row")) for b in group]), pa.array(n, pa.int64()), pa.array(k1, pa.int64()),
                pa.array(k2, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], names=["row", "n", "k1", "k2", "tokens"])

    return read


def _tallying(sketch: Sketch) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def send(batches):
        kept: list[np.ndarray] = []
        n = 0
        for b in batches:
            kept.append(b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            n += len(kept[-1])
            if n > _flush(sketch):
                yield from sketch.touched(np.concatenate(kept), tally=True)
                kept, n = [], 0
        if n:
            yield from sketch.touched(np.concatenate(kept), tally=True)

    return send


def _prefixing(sketch: Sketch, tallies: Merged) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tokens that the tally saw twice, and the rarest of them as prefix keys; sets with too many tokens of their own drop out."""
    def read(batches):
        for b in batches:
            row, sets, sizes = _trees(pa.Table.from_batches([b]))
            if not len(row):
                continue
            flat = np.concatenate(sets)
            count = sketch.counts(tallies, flat)
            found, start = [], 0
            for r, s, n in zip(row.tolist(), sets, sizes.tolist()):
                own = count[start:start + len(s)]
                start += len(s)
                kept = s[own > 1]
                few = allowed(n) - (n - len(kept))
                if few > 0:
                    found.append((r, n, kept.view(np.int64), kept[np.argsort(own[own > 1], kind="stable")][:few].view(np.int64)))
            if found:
                r, n, tokens, keys = zip(*found)
                yield pa.RecordBatch.from_arrays([
                    pa.array(r, pa.int64()), pa.array(n, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                    names=["row", "n", "tokens", "keys"])

    return read


def components(edges: DataFrame) -> DataFrame:
    """(node, component) from (key, node): nodes with a key in common belong together.

    Each round every node takes the smallest label among its keys' nodes, labels take the labels of
    their labels, and keys that hold one label only are left out; edges shrink as labels merge.
    """
    label = staged(edges.select("node").distinct().withColumn("component", F.col("node")))
    left = edges.select("key", F.col("node").alias("label")).distinct()
    while True:
        lows = left.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key", "low")
        moved = left.join(lows, "key").groupBy("label").agg(F.min("low").alias("low")).where("low < label")
        moved = staged(moved)
        if moved.isEmpty():
            return label
        onward = moved.select(F.col("label").alias("low"), F.col("low").alias("next"))
        moved = staged(moved.join(onward, "low", "left").select("label", F.coalesce("next", "low").alias("low")))
        left = staged(left.join(lows.select("key"), "key").join(moved, "label", "left").select(
            "key", F.coalesce("low", "label").alias("label")).distinct())
        label = staged(label.join(moved.withColumnRenamed("label", "component"), "component", "left").select(
            "node", F.coalesce("low", "component").alias("component")))


def _trees(part: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    lists = part["tokens"].combine_chunks()
    flat = lists.flatten().to_numpy().view(np.uint64)
    edge = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    return part["row"].to_numpy(), [flat[a:b] for a, b in zip(edge[:-1], edge[1:])], part["n"].to_numpy()


def _pairs(found: list[tuple[int, int]]) -> pa.Table:
    a, b = zip(*found) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def links_within(part: pa.Table) -> pa.Table:
    """Links inside each family (or block of one) of a bounded group."""
    out = []
    family = part["family"].to_numpy()
    order = np.argsort(family, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(family[order])) + 1):
        if len(at) > 1:
            rows, sets, sizes = _trees(part.take(at))
            tree = Tree(sets, sizes)
            out += [(int(rows[p]), int(rows[q])) for p, q in links(tree, tree, np.arange(len(at)), np.arange(len(at)))]
    return _pairs(out)


def links_between(_, inside: pa.Table, outside: pa.Table) -> pa.Table:
    """Links between two blocks of a family, but for those within one component."""
    if not inside.num_rows or not outside.num_rows:
        return _pairs([])
    (a, sets_a, n_a), (b, sets_b, n_b) = _trees(inside), _trees(outside)
    found = links(Tree(sets_a, n_a), Tree(sets_b, n_b), inside["component"].to_numpy(), outside["component"].to_numpy())
    return _pairs([(int(a[p]), int(b[q])) for p, q in found])


def star(pairs: DataFrame) -> DataFrame:
    """Links as (key, node) edges."""
    return pairs.select(F.col("a").alias("key"), F.explode(F.array("a", "b")).alias("node"))


def size_band(n):
    """Sets of a link lie at most ``BANDS`` bands of size apart."""
    return F.floor(F.log(F.col(n)) / F.log(F.lit(BAND))).cast("int")


def large_family_links(members: DataFrame, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(a, b): links that connect whatever is connected in ``members`` (family, row, n, tokens), families of any size.

    ``members`` is a written table; only the steps that compare sets read its tokens. Blocks hold
    sets of about one size, so that a set meets the blocks of like sizes only.
    """
    banded = members.withColumn("band", size_band("n"))
    bands = staged(banded.groupBy("family", "band").agg(F.ceil(F.count("*") * 2 / block).alias("blocks")))
    own = banded.join(F.broadcast(bands) if bands.count() <= BROADCAST_BANDS else bands, ["family", "band"]).withColumn(
        "block", F.pmod(F.xxhash64("row"), F.col("blocks")))
    found = staged(own.groupBy("family", "band", "block").applyInArrow(links_within, "a long, b long"))

    def known(pairs: DataFrame) -> DataFrame:
        """(family, row, component, main) by the links so far; ``main`` is the family's largest component."""
        named = components(star(pairs)).withColumnRenamed("node", "row")
        state = staged(own.select("family", "row").join(named, "row", "left").select("family", "row", F.coalesce("component", "row").alias("component")))
        counted = state.groupBy("family", "component").agg(F.count("*").alias("count"))
        return state.join(counted.groupBy("family").agg(F.max_by("component", F.struct("count", "component")).alias("main")), "family")

    state = known(found)
    for turn in range(pivots):
        choice = F.xxhash64(F.col("row"), F.lit(turn))
        pivot = state.where("component = main").groupBy("family").agg(F.min_by("row", choice).alias("pivot"))
        pivot = staged(own.select(F.col("row").alias("pivot"), F.col("tokens").alias("pivot_tokens"), F.col("n").alias("pivot_n")).join(F.broadcast(pivot) if _few(pivot) else pivot, "pivot"))
        common = F.size(F.array_intersect("tokens", "pivot_tokens"))
        near = own.join(F.broadcast(pivot) if _few(pivot) else pivot, "family").where(
            100 * common >= PERCENT * (F.col("n") + F.col("pivot_n") - common)).select("row", "pivot")
        near = staged(near.join(state.where("component != main").select("row"), "row").select(F.col("pivot").alias("a"), F.col("row").alias("b")))
        if near.isEmpty():
            break
        found = found.unionByName(near)
        state = known(found)
    outside = staged(state.where("component != main").select("row", "component"))
    if outside.isEmpty():
        return found
    apart = own.join(outside, "row").select("family", "band", "row", "n", "tokens", "component")
    near_band = F.explode(F.sequence(F.col("band") - BANDS, F.col("band") + BANDS))
    seen = staged(apart.select("family", near_band.alias("band")).groupBy("family", "band").agg(F.ceil(F.count("*") / (4 * block)).alias("turns"))
                  .join(bands, ["family", "band"]))
    left = own.join(state.select("row", "component"), "row").join(F.broadcast(seen.drop("blocks")) if seen.count() <= BROADCAST_BANDS else seen.drop("blocks"), ["family", "band"])
    left = left.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)))
    right = apart.withColumn("band", near_band).join(F.broadcast(seen) if seen.count() <= BROADCAST_BANDS else seen, ["family", "band"])
    right = right.withColumn("turn", F.pmod(F.xxhash64("row"), F.col("turns"))).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    key = ["family", "band", "block", "turn"]
    cols = [*key, "row", "n", "tokens", "component"]
    left, right = left.select(*cols), right.select(*[F.col(c).alias(c) for c in cols])
    crossing = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(links_between, "a long, b long")
    return found.unionByName(staged(crossing))


def _few(pivot: DataFrame) -> bool:
    """One set for each large family; beyond some thousand they are joined by a shuffle."""
    return pivot.count() <= BROADCAST_PIVOTS


def _sent(rows: DataFrame) -> DataFrame:
    """A written table of row numbers, broadcast where it is small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def similar_groups(own: DataFrame, gram: int = GRAM, sketches: tuple[Sketch, ...] | None = None, block: int = BLOCK) -> DataFrame:
    """(row, n_shingles, component) of every row of ``own`` (row, text); a component is its smallest row."""
    text = own.select("row", "text")
    held: list = []
    for sketch in sketches or sketches_for(text):
        held.append((sketch, sketch.bits(text.select("text").mapInArrow(_sketching(sketch, list(held), gram), SENT))))
    sets = staged(text.mapInArrow(_reading(held, gram), SETS))
    same = ["k1", "k2", "n"]
    classes = staged(sets.where("k1 IS NOT NULL").groupBy(*same).agg(F.min("row").alias("first")))
    distinct = staged(sets.select("row", "n", "tokens").join(_sent(classes.select(F.col("first").alias("row"))), "row"))
    tally = sized(distinct.agg(F.sum(F.size("tokens"))).first()[0] or 0)
    tallies = tally.bits(distinct.select("tokens").mapInArrow(_tallying(tally), SENT), tally=True)
    prefixes = distinct.mapInArrow(_prefixing(tally, tallies), PREFIXES)
    edges = staged(prefixes.select(F.explode("keys").alias("key"), F.col("row").alias("node")))
    several = edges.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    family = components(edges.join(several, "key")).select(F.col("node").alias("row"), F.col("component").alias("family"))
    size = family.groupBy("family").agg(F.count("*").alias("size"))
    placed = staged(family.join(size.where("size > 1"), "family"))
    members = staged(prefixes.select("row", "n", "tokens").join(_sent(placed), "row"))
    small = members.where(F.col("size") <= block)
    packs = max(1, -(-small.count() // PACK))
    found = small.withColumn("pack", F.pmod(F.xxhash64("family"), F.lit(packs))).groupBy("pack").applyInArrow(links_within, "a long, b long")
    large = members.where(F.col("size") > block)
    if not large.isEmpty():
        found = found.unionByName(large_family_links(large, block))
    named = components(star(staged(found))).select(F.col("node").alias("first"), "component")
    joined = sets.select("row", *same).join(classes, same, "left").join(named, "first", "left")
    return joined.select("row", F.col("n").alias("n_shingles"), F.coalesce("component", "first", "row").alias("component"))


def groups(docs: DataFrame, gram: int = GRAM, sketches: tuple[Sketch, ...] | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    own = keyed(docs)
    found = similar_groups(own, gram, sketches, block)
    ids = own.select("row", "doc_id")
    named = found.join(ids, "row").join(ids.select(F.col("row").alias("component"), F.col("doc_id").alias("component_id")), "component")
    return named.select("doc_id", "n_shingles", "component_id")


def first_of_groups(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates (its smallest), with all columns."""
    own = keyed(docs, whole=True)
    kept = similar_groups(own).where("row = component").select("row")
    return own.join(kept, "row", "left_semi").select("doc.*")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
