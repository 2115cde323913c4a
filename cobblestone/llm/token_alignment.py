"""Alignment of two tokenizers: which tokens of one end where tokens of the other do, and how often in the whole corpus.

Every text is encoded by a byte-level vocabulary (A) and a sentence-piece model (B) as a space and the text. Byte offsets
where tokens of both end cut the tokens into groups; the last tokens of a group are linked. No token is empty, so a group has
one link.

Counts come from an inverted index of pairs of ids. Documents are numbered inside blocks of at most ``BLOCK`` (fewer, if
they have more than ``LINKS`` links; a longer document is a block of its own). A posting is a pair in a block, with planes:
plane ``j`` is the compressed set of the block's documents whose number of links of that pair has bit ``j``, as rising 16-bit
numbers or, from ``DENSE`` documents on, as a bitmap. The planes OR-ed are the pair's documents; their popcounts, weighted by
``2^j``, its links. Sums over blocks are counts of the corpus. Scores go back along the postings: each plane adds its pair's
count, times ``2^j``, to its documents.

Postings are combined before they are shuffled, so the most frequent pair has one row per block; a task holds one block of
documents, or one vector of a block's sums. A block's rows are written together, so a repeated task repeats them whole.

Nulls: null and empty texts, and texts whose tokens do not spell a space and the text, have no tokens: zeros, and '' as
their digest. An empty table gives no rows. Repeated rows count each and get equal rows. Other columns than those named are
not read. White space runs that the fast encoder of A can't take are encoded by the reference encoder.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cobblestone.llm.common import stored

FOLDER = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: fixed values: how byte-level vocabularies of this kind split texts, and the sign for a space in pieces
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE_SIGN = "▁"

BLOCK = 4096
LINKS = 2 << 20
DENSE = 256  # documents of a plane from which on a bitmap is smaller
_LONG_GAP = re.compile(r"\s{4096}")
_SLOT_BITS, _ID_BITS = 12, 20


def byte_signs() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


class Encoders:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, folder: str):
        import sentencepiece
        import tiktoken

        self.path = os.path.join(folder, FILE_A)
        with open(self.path, encoding="utf-8") as file:
            stored_vocabulary = json.load(file)
        special = {x["id"] for x in stored_vocabulary["added_tokens"] if x["special"]}
        signs = byte_signs()
        ranks = {bytes(signs[c] for c in t): i for t, i in stored_vocabulary["model"]["vocab"].items() if i not in special}
        self.fast = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, FILE_B))
        self.bytes_a = [b""] * (1 + max(ranks.values()))
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = [self._piece(i) for i in range(self.pieces.get_piece_size())]
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in x]) for x in (self.bytes_a, self.bytes_b))
        n = max(len(self.bytes_a), len(self.bytes_b))
        if n > 1 << _ID_BITS:
            raise ValueError(f"vocabularies of more than {1 << _ID_BITS} ids")
        self.stride, self.signs = n, [f"{i}{end}" for end in ",|;" for i in range(n)]

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.pieces.is_byte(i) else piece.replace(SPACE_SIGN, " ").encode()

    @functools.cached_property
    def reference(self):
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.encode_special_tokens = True
        return out

    def encode_a(self, text: str) -> list[int]:
        if len(text) >= 4096 and _LONG_GAP.search(text):
            return self.reference.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def encode_b(self, text: str) -> list[int]:
        return self.pieces.encode(text)


@functools.lru_cache(maxsize=2)
def encoders(folder: str) -> Encoders:
    return Encoders(folder)


@dataclass
class Alignment:
    """Token ids of a text, and the positions of the last token of every group."""

    a: np.ndarray
    b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray

    def groups(self, signs: list[str], stride: int) -> str:
        """The groups as ``a1,a2|b1;a3|b2``: each id with the sign that follows it, laid in the order of the groups."""
        if not len(self.a):
            return ""
        in_a, in_b = (np.diff(x, prepend=-1) for x in (self.last_a, self.last_b))
        before = np.concatenate([[0], self.last_b[:-1] + 1])
        place_a = np.arange(len(self.a)) + np.repeat(before, in_a)
        place_b = np.arange(len(self.b)) + np.repeat(self.last_a + 1, in_b)
        sign = np.empty(len(self.a) + len(self.b), np.int64)
        sign[place_a], sign[place_b] = self.a, self.b
        sign[place_a[self.last_a]] += stride
        sign[place_b[self.last_b]] += 2 * stride
        return "".join(map(signs.__getitem__, sign.tolist()))[:-1]


_NONE = np.zeros(0, np.int64)


def align(text: str | None, with_: Encoders) -> Alignment:
    empty = Alignment(_NONE, _NONE, _NONE, _NONE)
    if not text:
        return empty
    a, b = with_.encode_a(" " + text), with_.encode_b(text)
    raw = b" " + text.encode()
    if b"".join(map(with_.bytes_b.__getitem__, b)) != raw or b"".join(map(with_.bytes_a.__getitem__, a)) != raw:
        return empty
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    end_a, end_b = np.cumsum(with_.sizes_a[a]), np.cumsum(with_.sizes_b[b])
    at = np.searchsorted(end_b, end_a)
    last_a = np.flatnonzero(end_b[at] == end_a)
    return Alignment(a, b, last_a, at[last_a])


def postings(pair: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The postings of a block: its different pairs, their numbers of documents and of links, and their planes."""
    key = np.sort((pair << _SLOT_BITS) | slot)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.diff(np.concatenate([first, [len(key)]]))
    key = key[first]
    pair, slot = key >> _SLOT_BITS, key & ((1 << _SLOT_BITS) - 1)
    start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    owner = np.repeat(np.arange(len(start)), np.diff(np.concatenate([start, [len(pair)]])))
    depth = np.frexp(np.maximum.reduceat(times, start).astype(float))[1].astype(np.int64)  # bits of the largest number
    offset = np.concatenate([[0], np.cumsum(depth)])
    planes, members = [], []
    for j in range(int(depth.max())):
        has = np.flatnonzero((times >> j) & 1)
        planes.append(offset[owner[has]] + j)
        members.append(slot[has])
    plane, member = np.concatenate(planes), np.concatenate(members)
    order = np.argsort(plane, kind="stable")
    plane, member = plane[order], member[order]
    counts = np.bincount(plane, minlength=offset[-1])
    # OR-ed, the planes hold each document once; weighted, they hold each link
    n_docs = np.diff(np.concatenate([start, [len(pair)]]))
    weights = np.left_shift(counts, np.arange(offset[-1]) - np.repeat(offset[:-1], depth))
    n_links = np.add.reduceat(weights, offset[:-1])
    size = np.where(counts >= DENSE, BLOCK // 8, 2 * counts)
    begin = np.concatenate([[0], np.cumsum(size)])
    data = np.zeros(begin[-1], np.uint8)
    dense = counts >= DENSE
    sparse = ~dense[plane]
    place = np.repeat(begin[:-1] - 2 * (np.cumsum(counts) - counts), counts) + 2 * np.arange(len(plane))
    data[place[sparse]] = member[sparse] & 255
    data[place[sparse] + 1] = member[sparse] >> 8
    at = np.concatenate([[0], np.cumsum(counts)])
    for p in np.flatnonzero(dense).tolist():
        bits = np.zeros(BLOCK, bool)
        bits[member[at[p] : at[p + 1]]] = True
        data[begin[p] : begin[p + 1]] = np.packbits(bits, bitorder="little")
    raw = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(begin.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    return pair[start], n_docs, n_links, pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), raw)


def members(planes: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posting, bit, document) of everything in the planes of a batch of postings."""
    planes = planes.combine_chunks() if isinstance(planes, pa.ChunkedArray) else planes
    depth = np.diff(planes.offsets.to_numpy())
    row = np.repeat(np.arange(len(planes)), depth)
    bit = np.arange(len(row)) - np.repeat(np.cumsum(depth) - depth, depth)
    flat = planes.flatten().cast(pa.large_binary())
    begin = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    raw = flat.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    size = np.diff(begin)
    dense = np.flatnonzero(size == BLOCK // 8)
    few = np.where(size == BLOCK // 8, 0, size) // 2
    place = np.repeat(begin[:-1] - 2 * (np.cumsum(few) - few), few) + 2 * np.arange(int(few.sum()))
    slot = data[place].astype(np.int64) | (data[place + 1].astype(np.int64) << 8)
    entry = np.repeat(np.arange(len(row)), few)
    if len(dense):
        maps = data[begin[dense][:, None] + np.arange(BLOCK // 8)]
        which, where = np.nonzero(np.unpackbits(maps, axis=1, bitorder="little"))
        entry, slot = np.concatenate([entry, dense[which]]), np.concatenate([slot, where])
    return row[entry], bit[entry], slot


_DOC = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
_POSTING = [("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64()), ("links", pa.int64()), ("planes", pa.list_(pa.binary()))]


def aligned(docs: DataFrame, text: str, keep: list[str], folder: str) -> DataFrame:
    """Rows of two kinds, told apart by ``a``: documents (block, slot, *keep, numbers, digest) and postings (block, a, b, planes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ = encoders(folder)
        block = TaskContext.get().partitionId() << 32
        rows, pairs, held = [], [], 0

        def close(kept: list[pa.Array]) -> Iterator[pa.RecordBatch]:
            names = ["block", "slot", *keep, *(n for n, _ in _DOC), *(n for n, _ in _POSTING)]
            n = len(rows)
            facts = [pa.array(column, kind) for column, (_, kind) in zip(zip(*rows), _DOC)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * n, pa.int64()), pa.array(range(n), pa.int32()), *kept, *facts, *(pa.nulls(n, k) for _, k in _POSTING)], names)
            counts = [len(p) for p in pairs]
            if sum(counts):
                pair, n_docs, n_links, planes = postings(np.concatenate(pairs), np.repeat(np.arange(n), counts))
                m = len(pair)
                inverted = [pa.array((pair >> _ID_BITS).astype(np.int32)), pa.array((pair & ((1 << _ID_BITS) - 1)).astype(np.int32)),
                            pa.array(n_docs), pa.array(n_links), planes]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * m, pa.int64()), pa.nulls(m, pa.int32()), *(pa.nulls(m, k.type) for k in kept),
                     *(pa.nulls(m, k) for _, k in _DOC), *inverted], names)

        columns: list[list] = [[] for _ in keep]

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, held
            if rows:
                yield from close([pa.concat_arrays(c) for c in columns])
            block, held = block + 1, 0
            rows.clear(), pairs.clear()
            for c in columns:
                c.clear()

        for batch in batches:
            for i, body in enumerate(batch.column(0)):
                found = align(body.as_py(), with_)
                groups = found.groups(with_.signs, with_.stride)
                n = len(found.last_a)
                digest = hashlib.sha256(groups.encode()).hexdigest() if n else ""
                if rows and (len(rows) == BLOCK or held + n > LINKS):
                    yield from flush()
                rows.append((len(found.a), len(found.b), n, n, digest))
                pairs.append((found.a[found.last_a] << _ID_BITS) | found.b[found.last_b])
                for c, column in zip(columns, batch.columns[1:]):
                    c.append(column.slice(i, 1))
                held += n
        yield from flush()

    kinds = {"int64": "bigint", "int32": "int", "string": "string"}
    schema = ["block bigint", "slot int", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)]
    schema += [f"{n} {kinds.get(str(k), 'array<binary>')}" for n, k in [*_DOC, *_POSTING]]
    return docs.select(F.col(text).alias("_text"), *keep).mapInArrow(run, ", ".join(schema))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, links, docs, best) over all postings: how often a pair is linked, in how many documents, and whether no other
    pair of its B id is linked more often."""
    found = stored(rows.where("a is not null").groupBy("a", "b").agg(F.sum("links").alias("links"), F.sum("docs").alias("docs")), "pairs")
    top = found.groupBy("b").agg(F.max("links").alias("top"))
    return found.join(top, "b").select("a", "b", "links", "docs", (F.col("links") == F.col("top")).alias("best"))


def _sums(slot: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Exact sums of 64-bit numbers by slot: floats hold the halves exactly."""
    low = np.bincount(slot, (value & ((1 << 26) - 1)).astype(float), BLOCK)
    return low.astype(np.int64) + (np.bincount(slot, (value >> 26).astype(float), BLOCK).astype(np.int64) << 26)


def scores(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(block, slot, n_best, count_sum): what the postings of ``rows`` return to their documents."""
    given = counts.select("a", "b", F.col("links").alias("count"), "best").hint("shuffle_hash")
    back = rows.where("a is not null").select("block", "a", "b", "planes").join(given, ["a", "b"])
    back = back.select("block", "count", "best", "planes").repartition("block").sortWithinPartitions("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best, total = None, None, None

        def out() -> pa.RecordBatch:
            some = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), block)), pa.array(some.astype(np.int32)), pa.array(best[some]), pa.array(total[some])],
                ["block", "slot", "n_best", "count_sum"])

        for batch in batches:
            if not batch.num_rows:
                continue
            owner = batch.column(0).to_numpy()
            count = batch.column(1).to_numpy()
            top = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            cut = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1, [len(owner)]]).tolist()
            for lo, hi in zip(cut, cut[1:]):
                if owner[lo] != block:
                    if block is not None:
                        yield out()
                    block, best, total = owner[lo], np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
                row, bit, slot = members(batch.column(3).slice(lo, hi - lo))
                times = np.left_shift(1, bit)
                total += _sums(slot, count[lo:hi][row] * times)
                best += _sums(slot, top[lo:hi][row] * times)
        if block is not None:
            yield out()

    return back.mapInArrow(run, "block bigint, slot int, n_best bigint, count_sum bigint")


def alignment(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), folder: str = FOLDER) -> DataFrame:
    """(*keep, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row per document."""
    names = [f"_{i}" for i in range(len(keep))]  # no name of the caller's can clash
    rows = stored(aligned(docs.select(F.col(text).alias("_body"), *(F.col(c).alias(n) for c, n in zip(keep, names))), "_body", names, folder), "aligned")
    returned = scores(rows, stored(pair_counts(rows), "counts"))
    known = rows.where("a is null").select("block", "slot", *names, *(n for n, _ in _DOC))
    zero = F.lit(0).cast("bigint")
    return known.join(returned, ["block", "slot"], "left").select(
        *(F.col(n).alias(c) for c, n in zip(keep, names)), "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
