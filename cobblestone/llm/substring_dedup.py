"""Removal of passages that recur anywhere in the corpus.

A *window* is ``size`` consecutive words of one document; a word goes if some window over it has a word sequence that also
starts at another place. The steps:

1. **Anchors.** The smallest hash among the ``gram``-word sequences of a window (the leftmost of equals) is its anchor.
   Equal windows have equal anchors at equal offsets, and neighbouring windows mostly share theirs, so about one word in
   fifteen is an anchor. The windows with one anchor form a *passage* (at most ``2 size - gram`` words).
2. **Confirmation.** Anchors that occur once cannot belong to a recurring window. If all occurrences of an anchor stand in
   one and the same passage, all windows of that passage recur. The others are compared window by window, on one exemplar
   of each different passage weighted by its count.
3. **Automata.** Each block of documents is a shard: the confirmed passages that occur in it, joined to maximal ones, are
   compiled into an Aho-Corasick automaton over word numbers, and every document of the block is streamed through it once;
   the union of the matches is removed. A shard holds no more words than its block, so memory is bounded, and no document
   meets more than one automaton. Block word numbers come from 64-bit word hashes.

What crosses the network: a row per anchor (not per word), the texts twice. Counts are combined before the shuffle, joins
are equi-joins that Spark can split when one key is hot; no group is collected except the marks of a single text.

Nulls: a null text has no words. ``doc_id`` and all other columns are passed through and never looked at, repeated rows
count as separate texts, an empty table gives an empty result. A text of fewer than ``size`` words keeps everything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cobblestone.llm.common import map_batches, stored, text_key
from cobblestone.llm.words import Words, mix, sliding_argmin, words_of

SIZE = 35
GRAM = 6
_SHIFT = 6  # a passage has at most size - gram + 1 <= 64 windows; positions carry that number in their low bits


def passages(words: Words, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, passage hash, first window, last window of every passage of the documents."""
    win, n = words.windows(size), len(words.begin)
    if not len(win):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    grams = words.spans(np.arange(n - gram + 1), np.arange(gram, n + 1))
    best = sliding_argmin(grams, size - gram + 1)[win]
    cut = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    lo, hi, at = win[cut], win[np.append(cut[1:] - 1, len(win) - 1)], best[cut]
    shape = ((at - lo) * 64 + (hi - lo)).astype(np.uint64)
    return grams[at], mix(words.spans(lo, hi + size) + mix(shape)), lo, hi


def _anchors(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """(a, p, k, at) for every passage of ``docs`` (k, text)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        for words in words_of(batch.column(1)):
            a, p, lo, hi = passages(words, size, gram)
            if len(a):
                doc = words.owner[lo]
                at = (lo - words.bounds[doc]) << _SHIFT | (hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(p.view(np.int64)), pa.array(keys[words.first + doc]), pa.array(at)],
                    ["a", "p", "k", "at"],
                )

    return map_batches(docs, run, "a bigint, p bigint, k bigint, at bigint")


def _marked(words: Words, lists, size: int, gram: int):
    """Passages of the documents that appear in their lists: (lo, hi, p, mask or count) as arrays."""
    _, p, lo, hi = passages(words, size, gram)
    if not len(p):
        return lo, hi, p, lo
    doc = words.owner[lo]
    at = (lo - words.bounds[doc]) << _SHIFT | (hi - lo)
    found, value = np.zeros(len(p), bool), np.zeros(len(p), np.int64)
    first = np.searchsorted(doc, np.arange(words.docs + 1))
    for d in range(words.docs):
        marks = lists[words.first + d]
        if marks is None or first[d] == first[d + 1]:
            continue
        place, name, extra = marks
        mine = at[first[d] : first[d + 1]]
        slot = np.minimum(np.searchsorted(mine, place), len(mine) - 1) + first[d]
        # a mark counts only where the words are those it was made for
        ok = (at[slot] == place) & (p[slot].view(np.int64) == name)
        found[slot[ok]] = True
        value[slot[ok]] = extra[ok]
    return lo[found], hi[found], p[found], value[found]


def _lists(column: pa.ListArray, fields: tuple[str, str, str]) -> list:
    """Each row's list of structs as three arrays, None for null."""
    values, offsets = column.values, column.offsets.to_numpy()
    parts = [values.field(f).to_numpy(zero_copy_only=False) for f in fields]
    return [
        tuple(x[offsets[i] : offsets[i + 1]] for x in parts) if column[i].is_valid else None for i in range(len(column))
    ]


def _windows(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """(p, n, off, w) for every window of the exemplar passages listed with each text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = _lists(batch.column(1), ("at", "p", "n"))
        for words in words_of(batch.column(0)):
            lo, hi, p, n = _marked(words, lists, size, gram)
            if len(lo):
                reps = hi - lo + 1
                off = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                at = np.repeat(lo, reps) + off
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(p, reps).view(np.int64)), pa.array(np.repeat(n, reps)), pa.array(off),
                     pa.array(words.spans(at, at + size).view(np.int64))], ["p", "n", "off", "w"])

    return map_batches(docs, run, "p bigint, n bigint, off bigint, w bigint")


def recurring(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(k, marks) per text key with recurring windows; marks lists (at, p, mask) with a bit per recurring window.

    ``docs`` has k = ``text_key`` and text. Tables are cut where they are used twice.
    """
    seen = _anchors(docs, size, gram)
    anchors = seen.groupBy("a").agg(F.count("*").alias("n"), F.min("p").alias("p0"), F.max("p").alias("p1"))
    anchors = anchors.where("n > 1").select("a", (F.col("p0") != F.col("p1")).alias("mixed"))
    # written before they are joined: Spark can split a hot key of a table, not of an aggregate in the same stage
    anchors = stored(anchors, "anchors")
    places = stored(seen.join(anchors, "a").select("k", "at", "p", "mixed"), "recurring")
    mixed = places.where("mixed").groupBy("p").agg(F.count("*").alias("n"), F.min(F.struct("k", "at")).alias("x"))
    exemplars = mixed.select("x.k", F.struct(F.col("x.at").alias("at"), "p", "n").alias("m")).groupBy("k").agg(
        F.collect_list("m").alias("marks")
    )
    # equal texts stand in for each other: the exemplar needs only one of them
    one = docs.join(exemplars, "k").select("text", "marks")
    windows = stored(_windows(one, size, gram), "windows")
    windows = windows.groupBy("p", "off", "w").agg(F.max("n").alias("n"))
    again = stored(windows.groupBy("w").agg(F.sum("n").alias("n")).where("n > 1").select("w"), "again")
    masks = windows.join(again, "w").groupBy("p").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("off").cast("int"))).alias("mask"))
    masks = stored(masks, "masks")
    whole = places.where("not mixed").select("k", "at", "p", F.lit(-1).cast("long").alias("mask"))
    parts = places.where("mixed").select("k", "at", "p").join(masks, "p").select("k", "at", "p", "mask")
    marks = whole.unionByName(parts).groupBy("k", "at", "p").agg(F.max("mask").alias("mask"))
    return marks.groupBy("k").agg(F.collect_list(F.struct("at", "p", "mask")).alias("marks"))


def _covered(words: Words, lists, size: int, gram: int) -> np.ndarray:
    """Which words are covered by recurring windows, found by one automaton over the documents of the chunk."""
    covered = np.zeros(len(words.begin), bool)
    lo, hi, _, mask = _marked(words, lists, size, gram)
    if not len(lo):
        return covered
    reps = hi - lo + 1
    off = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    on = (np.repeat(mask, reps) >> off) & 1 == 1
    starts = np.sort((np.repeat(lo, reps) + off)[on])
    if not len(starts):
        return covered
    # windows at consecutive places of one document make one passage
    owner = words.owner
    new = np.concatenate([[True], (np.diff(starts) != 1) | (owner[starts[1:]] != owner[starts[:-1]])])
    begin = starts[new]
    end = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)] + size
    numbers = np.unique(words.codes(), return_inverse=True)[1].tolist()
    automaton, seen = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), set()
    for code, b, e in zip(words.spans(begin, end).tolist(), begin.tolist(), end.tolist()):
        if code not in seen:
            seen.add(code)
            automaton.add_word(tuple(numbers[b:e]), e - b)
    automaton.make_automaton()
    bounds = words.bounds.tolist()
    step = np.zeros(len(words.begin) + 1, np.int64)
    for d in range(words.docs):
        if bounds[d + 1] - bounds[d] >= size:
            for last, length in automaton.iter(tuple(numbers[bounds[d] : bounds[d + 1]])):
                step[bounds[d] + last + 1 - length] += 1
                step[bounds[d] + last + 1] -= 1
    return np.cumsum(step[:-1]) > 0


def remove_recurring(docs: DataFrame, text: str = "text", size: int = SIZE, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """``docs`` with n_words, n_removed and the kept words joined by one space (``kept_text``, null if nothing went),
    or, with ``digest``, their SHA-256 in place of the text columns. Columns of these names are replaced, and those called
    ``_k``, ``_marks`` or ``_text`` left out (but for the text itself)."""
    names = ["n_words", "n_removed", "kept_sha256" if digest else "kept_text"]
    rest = [f for f in docs.schema.fields if f.name not in (*names, "_k", "_marks", "_text") and not (digest and f.name == text)]
    keyed = docs.select(text_key(text).alias("_k"), F.col(text).alias("_text"), *(F.col(f"`{f.name}`") for f in rest))
    marks = recurring(keyed.select(F.col("_k").alias("k"), F.col("_text").alias("text")), size, gram)
    joined = keyed.join(marks.select(F.col("k").alias("_k"), F.col("marks").alias("_marks")), "_k", "left")
    joined = joined.select("_text", "_marks", *(F.col(f"`{f.name}`") for f in rest))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = _lists(batch.column(1), ("at", "p", "mask"))
        for words in words_of(batch.column(0)):
            gone = _covered(words, lists, size, gram)
            removed = np.bincount(words.owner[gone], minlength=words.docs)
            raw, begin, end, bounds = words.data.tobytes(), words.begin.tolist(), words.end.tolist(), words.bounds.tolist()
            stay, kept = ~gone, []
            for d in range(words.docs):
                at = (np.flatnonzero(stay[bounds[d] : bounds[d + 1]]) + bounds[d]).tolist() if removed[d] else range(bounds[d], bounds[d + 1])
                if digest:
                    kept.append(hashlib.sha256(b" ".join([raw[begin[i] : end[i]] for i in at])).hexdigest())
                else:
                    kept.append(b" ".join([raw[begin[i] : end[i]] for i in at]).decode() if removed[d] else None)
            part = batch.slice(words.first, words.docs)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[2:], pa.array(words.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.string())],
                [f.name for f in rest] + names,
            )

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest) + f"n_words bigint, n_removed bigint, {names[2]} string"
    return map_batches(joined, run, schema)
