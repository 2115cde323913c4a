"""Near-duplicates by SimHash and Burkhard-Keller trees.

Fingerprints are 64 bits: a bit is set if it is set in more than half of the XXH64 values (seed 42) of a text's shingles.
Two fingerprints link at a Hamming distance of at most ``RADIUS`` = 3; groups are the connected components of the links.

Different fingerprints only are compared. Of five blocks of bits at least two are equal in any two fingerprints within
distance 3, so the ten pairs of blocks give ten keys per fingerprint and every link shares a key: no link is lost. The
fingerprints with one key form a shard of at most ``SHARD`` items; a larger key is cut into parts, and every two parts
meet in a cell of their own, so no task sees more than two parts. In a cell the first part becomes a BK-tree (children
keyed by their distance to the parent) and the second part searches it along edges within the radius. Links are reduced
to a spanning forest of the cell before they leave it; pairs of copies are never listed.

Nulls: a null text has no words and so the fingerprint zero, like an empty one; a null ``doc_id`` never names a component
unless nothing else is in it. Repeated rows have equal fingerprints. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from cobblestone.llm.common import map_batches, stored
from cobblestone.llm.words import Words, words_of
from cobblestone.operators.components import group_labels, link_components

RADIUS = 3
SHINGLE = 3
SHARD = 4096
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # first bit, width: RADIUS + 2 blocks, so two stay equal
_QUERIES = 512  # searched at once


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of every document's shingles, and the bounds of the documents.

    A document of fewer than ``size`` words has one shingle, the whole of it; one without words has none.
    """
    n, length = len(words.begin), words.end - words.begin
    # the words again, one space apart
    begin = np.concatenate([[0], np.cumsum(length + 1)])
    joined = np.full(int(begin[-1]), 0x20, np.uint8)
    inner = np.repeat(words.begin - (begin[:-1]), length)
    place = np.arange(int(length.sum())) + np.repeat(np.arange(n), length)
    joined[place] = words.data[place + inner]
    counts = words.counts
    shingles = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(shingles)])
    first = np.repeat(words.bounds[:-1] - bounds[:-1], shingles) + np.arange(bounds[-1])
    last = np.minimum(first + size, np.repeat(words.bounds[1:], shingles))
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    values = [digest(raw[b:e], 42) for b, e in zip(begin[first].tolist(), (begin[last] - 1).tolist())]
    return np.array(values, np.uint64), bounds


def fingerprints_of(words: Words, size: int = SHINGLE) -> np.ndarray:
    values, bounds = shingle_hashes(words, size)
    out = np.zeros(words.docs, np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, bounds[some], axis=0, dtype=np.int32)
        majority = 2 * ones > np.diff(bounds)[some][:, None]
        out[some] = np.packbits(majority, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``docs`` without its text, with ``fp`` (64 bits as a signed number)."""
    rest = [f for f in docs.schema.fields if f.name not in (text, "fp")]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for words in words_of(batch.column(0), lower=True):
            part = batch.slice(words.first, words.docs)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array(fingerprints_of(words, size).view(np.int64))], [f.name for f in rest] + ["fp"]
            )

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest) + "fp bigint"
    return map_batches(docs.select(F.col(text).alias("_text"), *(F.col(f"`{f.name}`") for f in rest)), run, schema)


def bk_forest(fp: np.ndarray, root: np.ndarray) -> np.ndarray:
    """BK-trees over ``fp``, one per value of ``root`` (the index of the first item of its tree).

    Returns the children: ``child[node * 65 + distance]``, -1 where there is none. All trees grow level by level.
    """
    child = np.full(len(fp) * 65, -1, np.int32)
    rest = np.flatnonzero(root != np.arange(len(fp)))
    node = root[rest]
    while len(rest):
        edge = node * 65 + np.bitwise_count(fp[rest] ^ fp[node]).astype(np.int64)
        free = np.flatnonzero(child[edge] < 0)
        slot, first = np.unique(edge[free], return_index=True)
        child[slot] = rest[free[first]]
        node = child[edge].astype(np.int64)
        stay = node != rest
        rest, node = rest[stay], node[stay]
    return child


def bk_search(fp: np.ndarray, child: np.ndarray, query: np.ndarray, root: np.ndarray, radius: int):
    """Pairs (query index, node) within ``radius``; a query starts at its root and follows edges within the radius."""
    at, node = np.arange(len(query)), root
    pairs = []
    while len(at):
        far = np.bitwise_count(query[at] ^ fp[node]).astype(np.int64)
        near = far <= radius
        pairs.append((at[near], node[near]))
        nexts = []
        for step in range(-radius, radius + 1):
            edge = far + step
            ok = (edge > 0) & (edge <= 64)
            down = child[node[ok] * 65 + edge[ok]]
            nexts.append((at[ok][down >= 0], down[down >= 0].astype(np.int64)))
        at, node = (np.concatenate(x) for x in zip(*nexts))
    return tuple(np.concatenate(x) for x in zip(*pairs)) if pairs else (at, node)


def _forest_links(cell: np.ndarray, tree: np.ndarray, search: np.ndarray, fp: np.ndarray, radius: int):
    """Spanning links of the near fingerprints of each cell (``cell`` numbers are sorted)."""
    nodes = np.flatnonzero(tree)
    tree_cell = cell[nodes]
    root = np.searchsorted(tree_cell, tree_cell)
    child = bk_forest(fp[nodes], root)
    asks = np.flatnonzero(search & np.isin(cell, tree_cell))
    label = np.arange(len(fp))
    for i in range(0, len(asks), _QUERIES):
        part = asks[i : i + _QUERIES]
        q, found = bk_search(fp[nodes], child, fp[part], np.searchsorted(tree_cell, cell[part]), radius)
        a, b = part[q], nodes[found]
        label = group_labels(len(fp), np.concatenate([label, a]), np.concatenate([np.arange(len(fp)), b]))
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def _keys() -> list[Column]:
    def bits(first, width):
        return F.shiftrightunsigned("fp", first).bitwiseAND((1 << width) - 1)

    out = []
    for i, (first, width) in enumerate(BLOCKS):
        for other, wide in BLOCKS[i + 1 :]:
            out.append(F.lit(len(out) << 32) + F.shiftleft(bits(first, width), wide) + bits(other, wide))
    return out


def links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): enough links among the different fingerprints ``fp`` to join all within ``radius`` (at most 3)."""
    if radius > RADIUS:
        raise ValueError(f"the blocks guarantee links up to distance {RADIUS}")
    keyed = prints.select("fp", F.explode(F.array(*_keys())).alias("key"))
    # written, so that the join reads it as a table and Spark can split a hot key
    sizes = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    parts = F.ceil(F.col("n") / F.lit(shard)).cast("bigint")
    placed = keyed.join(sizes, "key").select("key", "fp", parts.alias("parts"), F.pmod(F.xxhash64("fp"), parts).alias("part"))
    placed = placed.select("key", "fp", "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("other"))
    cells = placed.select(
        "key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "fp"
    ).repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def solve(rows: np.ndarray) -> pa.RecordBatch:
            new = np.any(rows[1:, :3] != rows[:-1, :3], axis=1)
            cell = np.concatenate([[0], np.cumsum(new)])
            a, b = _forest_links(cell, rows[:, 3] == rows[:, 1], rows[:, 3] == rows[:, 2], rows[:, 4].copy().view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            if not len(rows):
                continue
            rows = np.concatenate([*held, rows])
            # the last cell may go on in the next batch
            cut = int(np.flatnonzero(np.any(rows[:, :3] != rows[-1, :3], axis=1))[-1]) + 1 if np.any(rows[0, :3] != rows[-1, :3]) else 0
            held = [rows[cut:]]
            if cut:
                yield solve(rows[:cut])
        if held:
            yield solve(np.concatenate(held))

    return cells.mapInArrow(run, "a bigint, b bigint").distinct()


def components(prints: DataFrame, ident: str = "doc_id") -> DataFrame:
    """(fp, component_id): the smallest ``ident`` reachable from each different fingerprint of ``prints`` (ident, fp)."""
    different = stored(prints.groupBy("fp").agg(F.min(ident).alias("least")), "fingerprints")
    groups = link_components(links(different))
    named = different.join(groups.withColumnRenamed("item", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = stored(named.groupBy("component").agg(F.min("least").alias("component_id")), "components")
    return named.select("fp", "component").join(least, "component").select("fp", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", ident: str = "doc_id", size: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(ident, *keep, fp, component_id), a row per document."""
    prints = stored(fingerprints(docs.select(F.col(text).alias("_body"), ident, *keep), "_body", size), "prints")
    return prints.join(components(prints, ident), "fp").select(ident, *keep, "fp", "component_id")
