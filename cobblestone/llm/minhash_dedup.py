"""Near-duplicates by MinHash: bottom-k sketches from one hash function, inverted lists, exact Jaccard similarity.

A text's set holds its different shingles of ``SHINGLE`` ASCII case folded words (a shorter text: the whole sequence). Equal
sets are one node. Its sketch is the ``KEPT`` smallest of the shingles' hash values, all of them if the set is smaller.

The ``KEPT`` smallest values of a union are a uniform sample of it and known from two sketches. Of a pair at the threshold so
few of them are in both sets as ``least_shared`` says with a chance of at most ``LOSS`` = 1e-9; that is all that can be lost,
and only of sets larger than a sketch (smaller ones are bounded exactly). So both sketches hold so many values of the other:

* Inverted lists of the values are counted; a node with too few values that others have too is done. The values of the rest
  are put in one order, rare ones first, and only as many of the first ones name a list as are needed for every pair to meet.
* In each of ``ROUNDS`` a list's members meet one member, another one each time, if it is in another component; of its lists a
  node takes up to ``MEETS`` such members. A group of near copies thus costs its rows, not its pairs. Then all members of a list
  that are still in different components meet, ``BLOCK`` against ``BLOCK`` of a long list.
* Pairs are held against sizes and bitmaps as they are joined, before they are written. A bitmap has the parity of the
  shingles that fall on each of ``64 * LONGS`` bits, so the bits that differ are at most the shingles that differ: no similar
  pair is dropped. The sketch of their union estimates the similarity of the different pairs that are left, and what passes
  is confirmed by the similarity of the full sets.

Nulls: a null text has an empty set, like an empty text; near_duplicates() takes all of those for one node, linked() for
linked with nothing. Repeated rows are one node. An empty table gives no rows. Sketches bound what a very long text costs
but for its own set. Columns named in ``keep`` pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from cobblestone.llm.common import discard, stored, text_key
from cobblestone.llm.words import Words, words_of
from cobblestone.operators.components import link_components

SHINGLE = 5
SIMILARITY = (85, 100)
KEPT = 48
LOSS = 1e-9
ROUNDS = 2
MEETS = 8
BLOCK = 1024
LONGS = 16


def least_shared(kept: int, num: int, den: int, loss: float = LOSS) -> int:
    """The number of values of a union's sketch that are in both sets, but for a chance of ``loss`` at similarity num / den."""
    t, tail = num / den, 0.0
    for i in range(kept + 1):
        tail += comb(kept, i) * t**i * (1 - t) ** (kept - i)
        if tail > loss:
            return i
    return kept


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash values of every document's different shingles, rising, and the bounds of the documents.

    A document of fewer than ``size`` words has one shingle, the whole of it; one without words has none.
    """
    counts = words.counts
    shingles = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(shingles)])
    first = np.repeat(words.bounds[:-1] - bounds[:-1], shingles) + np.arange(bounds[-1])
    values = words.spans(first, np.minimum(first + size, np.repeat(words.bounds[1:], shingles))).view(np.int64)
    owner = np.repeat(np.arange(words.docs), shingles)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return values[new], np.searchsorted(owner[new], np.arange(words.docs + 1))


def _nodes(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    raw, at = values.astype("<i8").tobytes(), (bounds * 8).tolist()
    return np.array([xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in zip(at, at[1:])], np.uint64).view(np.int64)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


_MAP = [f"w{i}" for i in range(LONGS)]


def _bitmaps(values: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    bits = np.zeros((LONGS, len(n)), np.uint64)
    place = values.view(np.uint64) % np.uint64(64 * LONGS)
    np.bitwise_xor.at(bits, ((place >> np.uint64(6)).astype(np.int64), np.repeat(np.arange(len(n)), n)), np.uint64(1) << (place & np.uint64(63)))
    return [pa.array(w.view(np.int64)) for w in bits]


def _scan(docs: DataFrame, fn: Callable[[pa.RecordBatch, Words], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` over the texts (first column) of a table, a bounded number of bytes at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column(0), lower=True):
                yield fn(batch.slice(words.first, words.docs), words)

    return docs.mapInArrow(run, schema)


def sketches(docs: DataFrame, text: str, keep: tuple[str, ...], size: int, kept: int) -> DataFrame:
    """(*keep, node, n, sketch, w0, w1, ...): a row per document; ``n`` is the size of its set, w the longs of its bitmap."""
    def run(part, words):
        values, bounds = shingle_sets(words, size)
        n = np.diff(bounds)
        rank = np.arange(len(values)) - np.repeat(bounds[:-1], n)
        short = np.concatenate([[0], np.cumsum(np.minimum(n, kept))])
        columns = [*part.columns[1:], pa.array(_nodes(values, bounds)), pa.array(n), _lists(values[rank < kept], short), *_bitmaps(values, n)]
        return pa.RecordBatch.from_arrays(columns, [*keep, "node", "n", "sketch", *_MAP])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep) + "node bigint, n bigint, sketch array<bigint>"
    return _scan(docs.select(F.col(text).alias("_text"), *(F.col(f"`{c}`") for c in keep)), run, kinds + "".join(f", {w} bigint" for w in _MAP))


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """(node, own): the whole sets of the texts ``_text``."""
    def run(part, words):
        values, bounds = shingle_sets(words, size)
        return pa.RecordBatch.from_arrays([pa.array(_nodes(values, bounds)), _lists(values, bounds)], ["node", "own"])

    return _scan(docs.select("_text"), run, "node bigint, own array<bigint>")


class _Threshold:
    """What a similarity of num / den demands of sizes, sketches and sets."""

    def __init__(self, num: int, den: int, kept: int):
        self.num, self.den, self.kept = num, den, kept
        self.sampled = least_shared(kept, num, den)

    def alone(self) -> Column:
        """Sets (of size ``n``) that equal sets only can be similar to."""
        return (F.floor(F.col("n") * self.den / self.num) == F.col("n")) & (F.ceil(F.col("n") * self.num / self.den) == F.col("n"))

    def least(self) -> Column:
        """The number of values of its sketch that a set shares with any similar one's."""
        whole = F.col("n") * self.den < self.kept * self.num  # any union with it is smaller than a sketch
        return F.when(whole, F.ceil(F.col("n") * self.num / self.den)).otherwise(self.sampled).cast("int")

    def possible(self, a: str, b: str) -> Column:
        """May the sets with sizes and bitmaps in the columns ``n_a``, ``w0_a`` and so on be similar? Exact: none is lost."""
        m, n = F.col(f"n_{a}"), F.col(f"n_{b}")
        apart = sum((F.bit_count(F.col(f"{w}_{a}").bitwiseXOR(F.col(f"{w}_{b}"))) for w in _MAP), F.lit(0))
        # num / den of the union in both: of m + n shingles at most this share differs
        return (self.den * F.least(m, n) >= self.num * F.greatest(m, n)) & ((self.num + self.den) * apart <= (self.den - self.num) * (m + n))

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sketches ``x`` and ``y`` let them be similar; exact where their union is smaller than a sketch."""
        pairs = pairs.withColumn("_u", F.slice(F.array_sort(F.array_union("x", "y")), 1, self.kept))
        pairs = pairs.withColumn("_both", F.size(F.array_intersect(F.array_intersect("x", "y"), "_u")))
        few = F.size("_u") < self.kept
        return pairs.where((few & (self.den * F.col("_both") >= self.num * F.size("_u"))) | (~few & (F.col("_both") >= self.sampled))).drop("_u", "_both")

    def similar(self, x: Column, y: Column) -> Column:
        both = F.size(F.array_intersect(x, y))
        return (self.num + self.den) * both >= self.num * (F.size(x) + F.size(y))


def _sided(nodes: DataFrame, side: str) -> DataFrame:
    """(node, n, w0, ...) with the names of one side of a pair."""
    return nodes.select(*(F.col(c).alias(f"{c}_{side}") for c in ("node", "n", *_MAP)))


def _ordered(nodes: DataFrame, limit: _Threshold) -> DataFrame:
    """(node, n, sketch, least, common, w0, ...): the nodes that others may be similar to, with the values they share, rare ones first."""
    rows = nodes.where(~limit.alone()).select("node", F.explode("sketch").alias("value"))
    times = stored(rows.groupBy("value").agg(F.count("*").alias("times")).where("times > 1"), "times")
    common = rows.join(times, "value").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("times", "value"))).alias("c"))
    few = nodes.select("node", "n", "sketch", limit.least().alias("least"), *_MAP)
    out = common.join(few, "node").where(F.size("c") >= F.col("least"))
    out = stored(out.select("node", "n", "sketch", "least", F.col("c.value").alias("common"), *_MAP), "ordered")
    discard(times)
    return out


def _first_lists(ordered: DataFrame) -> DataFrame:
    """(node, place, key): a list per value that is among the first of some nodes', ``place`` of them before it."""
    return ordered.select("node", F.posexplode(F.slice("common", 1, F.size("common") - F.col("least") + 1)).alias("place", "key"))


def _mixed(lists: DataFrame) -> DataFrame:
    """(key, members) of the lists (key, node, component) with several components."""
    found = lists.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"))
    return found.where("lo != hi").select("key", "members")


def _grouped(links: DataFrame) -> DataFrame:
    """(node, component) of all that is linked."""
    return stored(link_components(links).withColumnRenamed("item", "node"), "groups")


def _labelled(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    """``rows`` with the component of their ``node``."""
    if groups is None:
        return rows.withColumn("component", F.col("node"))
    return rows.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _confirmed(pairs: DataFrame, ordered: DataFrame, own: DataFrame, limit: _Threshold) -> DataFrame:
    """The pairs (a, b) that sketches let be similar and whose full sets are."""
    def both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
        for node, name in (("a", "x"), ("b", "y")):
            pairs = pairs.join(table.select(F.col("node").alias(node), F.col(column).alias(name)), node)
        return pairs

    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    likely = stored(limit.likely(both(pairs, ordered, "sketch")).select("a", "b"), "likely")
    found = stored(both(likely, own, "own").where(limit.similar(F.col("x"), F.col("y"))).select("a", "b"), "links")
    discard(pairs, likely)
    return found


def _crossing(lists: DataFrame, ordered: DataFrame, limit: _Threshold) -> DataFrame:
    """Pairs (a, b) of a list (key, members, node, place, component) in different components that sizes and bitmaps let be similar.

    Two blocks of a list meet in a cell of their own, and a pair is named by the first list that both are in."""
    blocks = F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")
    placed = lists.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = placed.select("key", "node", "place", "component", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    cells = cells.join(ordered.select("node", "n", "common", *_MAP), "node").withColumn("before", F.slice("common", 1, F.col("place")))
    columns = ("node", "component", "block", "n", "before", *_MAP)
    a, b = (cells.select("key", "lo", "hi", *(F.col(c).alias(f"{c}_{s}") for c in columns)) for s in "ab")
    placed_so = (F.col("block_a") == F.col("lo")) & (F.col("block_b") == F.col("hi"))
    once = (F.col("lo") < F.col("hi")) | (F.col("node_a") < F.col("node_b"))
    apart = (F.col("component_a") != F.col("component_b")) & limit.possible("a", "b") & ~F.arrays_overlap("before_a", "before_b")
    return a.join(b, ["key", "lo", "hi"]).where(placed_so & once & apart).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _components(ordered: DataFrame, own: DataFrame, limit: _Threshold) -> DataFrame | None:
    """(node, component) of the nodes that similar ones are joined to; None if there are none."""
    links = groups = None

    def add(found: DataFrame) -> None:
        nonlocal links, groups
        if found.limit(1).count():
            links = found if links is None else links.union(found)
            groups = _grouped(links)

    for step in range(ROUNDS):
        lists = stored(_labelled(_first_lists(ordered), groups), "lists")
        pick = F.min_by(F.struct("node", "component"), F.xxhash64("node", "key", F.lit(step))).alias("one")
        pivots = lists.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), pick).where("lo != hi")
        met = lists.join(pivots, "key").where(F.col("component") != F.col("one.component"))
        met = met.select(F.col("node").alias("node_a"), F.col("one.node").alias("node_b")).distinct()
        near = met.join(_sided(ordered, "a"), "node_a").join(_sided(ordered, "b"), "node_b").where(limit.possible("a", "b"))
        place = F.row_number().over(Window.partitionBy("node_a").orderBy(F.xxhash64("node_b", F.lit(step))))
        some = near.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), place.alias("place")).where(F.col("place") <= MEETS)
        add(_confirmed(some, ordered, own, limit))
        discard(lists)
    # and then all that are not in one component
    lists = stored(_labelled(_first_lists(ordered), groups), "lists")
    apart = stored(lists.join(_mixed(lists), "key"), "apart")
    add(_confirmed(_crossing(apart, ordered, limit), ordered, own, limit))
    discard(lists, apart)
    return groups


def near_duplicates(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), similarity: tuple[int, int] = SIMILARITY,
    size: int = SHINGLE, kept: int = KEPT,
) -> DataFrame:
    """(*keep, node, n, component), a row per document; ``component`` is that of the links of at least the similarity."""
    limit = _Threshold(*similarity, kept)
    names = tuple(f"_{i}" for i in range(len(keep)))  # no name of the caller's can clash
    docs = docs.select(F.col(text).alias("_text"), text_key(text).alias("_key"), *(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)))
    known = stored(sketches(docs, "_text", ("_key", *names), size, kept), "sketches")
    nodes = stored(known.select("node", "n", "sketch", *_MAP, "_key").dropDuplicates(["node"]), "nodes")
    ordered = _ordered(nodes, limit)
    texts = docs.select("_text", "_key").join(nodes.select("node", "_key").join(ordered.select("node"), "node", "left_semi"), "_key")
    own = stored(full_sets(texts.dropDuplicates(["node"]), size).dropDuplicates(["node"]), "own")
    groups = _components(ordered, own, limit)
    discard(nodes, ordered, own)
    found = _labelled(known.select("node", "n", *names), groups)
    return found.select(*(F.col(n).alias(c) for c, n in zip(keep, names)), "node", "n", "component")


def linked(docs: DataFrame, text: str = "text", ident: str = "doc_id", similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(ident, n_shingles, component_id, kept), a row per document; ``component_id`` is the smallest ``ident`` reachable.

    Documents without words are linked with nothing. A null ``ident`` names a component only if nothing else is in it."""
    found = near_duplicates(docs, text, (ident,), similarity)
    least = stored(found.where("n > 0").groupBy("component").agg(F.min(ident).alias("_least")), "least")
    named = found.join(least, (F.col("n") > 0) & (found["component"] == least["component"]), "left")
    first = F.when(F.col("n") > 0, F.col("_least")).otherwise(F.col(ident))
    return named.select(
        F.col(ident), F.col("n").alias("n_shingles"), first.alias("component_id"), F.col(ident).eqNullSafe(first).alias("kept"))
