"""Groups of spelling variants: words one edit apart, found by Gram matrices of letter counts.

A word is a maximal run of Latin letters (``RUN``), ASCII case folded, of at least ``MIN_LENGTH`` code points and
``MIN_TIMES`` occurrences in all texts. One inserted or deleted letter moves a vector of letter counts by a squared distance
of 1, one replaced letter by 2, so words further apart than 2 are never near.

Blocks are the words with equal numbers of letters of ``CLASSES`` classes (code point modulo ``CLASSES``); the sum of these
numbers is the length. An edit changes them by one insertion (the next length) or moves one letter between classes, so a
block has at most ``CLASSES + CLASSES * (CLASSES - 1) / 2`` neighbours on one side and every near pair lies in a block or
between a block and such a neighbour. A cell is a part of a block (about ``PART`` words, fewer long ones) with all words of
the block's later parts and of its neighbours as guests, which stream past it: a NumPy product of the letter counts of the
part and of a batch of guests gives the squared distances, pairs at most 2 apart are verified letter by letter. A cell
returns sums and best partners per word, no pairs, and no task holds more than one part and one batch.

Forms lead to words of at least twice the occurrences, so chains are short; roots are found by pointer jumping.

Nulls: a null text has no words; a null ``doc_id`` is written as the empty string before the hash. Empty texts and tables
give no rows. Repeated rows count each. Very long texts are cut between runs. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cobblestone.llm.common import stored

#: fixed values of the words counted
RUN = re.compile("[A-Za-zÀ-ÿ]+")
OTHER = re.compile("[^A-Za-zÀ-ÿ]")
MIN_LENGTH = 5
MIN_TIMES = 3
DROP_EVERY = 97

CLASSES = 5
PART = 4096
PIECE = 1 << 20  # letters of a text looked at together
HELD = 1 << 19  # different words counted in a task before they are handed on
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LETTERS = 26 + 64  # a-z and U+00C0 to U+00FF


def runs(text: str) -> Counter:
    """The runs of a text with their numbers."""
    found, at = Counter(), 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            stop = OTHER.search(text, end)
            end = stop.start() if stop else len(text)
        found.update(RUN.findall(text, at, end))
        at = end
    return found


def misspelt(run: str, start: int) -> str:
    """``run`` as counted: without one of its letters where its hash, begun with ``start``, says so."""
    h = zlib.crc32(run.encode(), start)
    if h % DROP_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(word, n): the words of all texts."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for name, body in zip(batch.column(0), batch.column(1)):
                body = body.as_buffer()
                if body is None:
                    continue
                start = zlib.crc32(f"{name.as_py() if name.is_valid else ''}:".encode())
                for run, n in runs(body.to_pybytes().translate(_LOWER).decode()).items():
                    word = misspelt(run, start)
                    if len(word) >= MIN_LENGTH:
                        held[word] += n
                if len(held) >= HELD:
                    yield hand_on()
        yield hand_on()

    parts = docs.select(F.col(ident).cast("string"), F.col(text)).mapInArrow(counted, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_TIMES)


def _points(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.array(words, f"<U{length}").view(np.uint32).reshape(len(words), length)


def letter_counts(points: np.ndarray) -> np.ndarray:
    """The letter counts of a block, as floats that hold all squared distances exactly."""
    n, length = points.shape
    letter = np.where(points < 0xC0, points - 97, points - 0xC0 + 26).astype(np.int64)
    flat = (letter + np.arange(n)[:, None] * _LETTERS).ravel()
    counts = np.bincount(flat, minlength=n * _LETTERS).reshape(n, _LETTERS)
    return counts.astype(np.float32 if length < 2048 else np.float64)


def close_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two blocks of letter counts whose squared distance is at most 2, by a Gram matrix."""
    gram = a @ b.T
    apart = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * gram
    return np.nonzero(apart <= 2)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of code points: do they differ by exactly one replaced letter, or (``b`` longer by one) one inserted?"""
    n, length = a.shape
    out = np.zeros(n, bool)
    step = max(1, (1 << 21) // max(length, 1))
    for i in range(0, n, step):
        x, y = a[i : i + step], b[i : i + step]
        if y.shape[1] == length:
            out[i : i + step] = (x != y).sum(1) == 1
        else:
            differs = x != y[:, :length]
            first = np.where(differs.any(1), differs.argmax(1), length)
            later = np.arange(length) >= first[:, None]
            out[i : i + step] = ~((x != y[:, 1:]) & later).any(1)
    return out


def near_in_cell(home: list[str], guests: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (home, guest) one edit apart; the home words have one length, the guests that or one more."""
    length = len(home[0])
    mine = _points(home, length)
    counts = letter_counts(mine)
    lengths = np.array([len(w) for w in guests])
    found = []
    for size in (length, length + 1):
        at = np.flatnonzero(lengths == size)
        for i in range(0, len(at), PART):
            part = at[i : i + PART]
            theirs = _points([guests[j] for j in part.tolist()], size)
            h, g = close_pairs(counts, letter_counts(theirs).astype(counts.dtype))
            ok = one_edit(mine[h], theirs[g])
            found.append((h[ok], part[g[ok]]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _summary(words: list[str], n: list[int], a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(word, n_near, best_n, best) for pairs of indices into ``words``, seen from ``a``."""
    if not len(a):
        return
    times = np.array(n)
    rank = np.empty(len(words), np.int64)
    rank[np.array(sorted(range(len(words)), key=words.__getitem__))] = np.arange(len(words))
    order = np.lexsort((rank[b], -times[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    n_near = np.diff(np.concatenate([first, [len(a)]]))
    some, best = a[first].tolist(), b[first]
    yield pa.RecordBatch.from_arrays(
        [pa.array([words[i] for i in some]), pa.array(n_near), pa.array(times[best]), pa.array([words[i] for i in best.tolist()])],
        ["word", "n_near", "best_n", "best"],
    )


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, guest, word, n), home words of a cell first, then its guests in batches of any size."""
    cell, home, home_n, met = None, [], [], False

    def within():
        if home:  # a part may have no words
            a, b = near_in_cell(home, home)
            yield from _summary(home, home_n, a, b)

    for batch in batches:
        if not batch.num_rows:
            continue
        cells = batch.column(0)
        codes = cells.dictionary_encode().indices.to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        for lo, hi in zip(cut.tolist(), np.concatenate([cut[1:], [batch.num_rows]]).tolist()):
            rows = batch.slice(lo, hi - lo)
            if cells[lo].as_py() != cell:
                if cell is not None and not met:
                    yield from within()
                cell, home, home_n, met = cells[lo].as_py(), [], [], False
            guest = rows.column(1).to_numpy(zero_copy_only=False).astype(bool)
            words, n = rows.column(2).to_pylist(), rows.column(3).to_pylist()
            own = int((~guest).sum())  # home rows come first
            home += words[:own]
            home_n += n[:own]
            if own < len(words) and home:
                if not met:
                    yield from within()
                    met = True
                a, b = near_in_cell(home, words[own:])
                both, both_n, b = home + words[own:], home_n + n[own:], b + len(home)
                yield from _summary(both, both_n, np.concatenate([a, b]), np.concatenate([b, a]))
    if cell is not None and not met:
        yield from within()


def _blocks(words: DataFrame) -> DataFrame:
    """``words`` (word, n) with their numbers of letters by class, ``c0``, ``c1`` and so on."""
    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            owner = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
            points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
            counts = np.bincount(owner * CLASSES + points % CLASSES, minlength=len(texts) * CLASSES).reshape(-1, CLASSES)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c.astype(np.int32)) for c in counts.T)], ["word", "n", *_CLASS])

    return words.mapInArrow(classed, "word string, n bigint" + "".join(f", {c} int" for c in _CLASS))


_CLASS = [f"c{i}" for i in range(CLASSES)]


def _moved(less: int, more: int | None = None) -> Column:
    """The block that has one letter of class ``less`` fewer (and one of class ``more`` more); null if there is none."""
    counts = [F.col(c) + (int(i == more) - int(i == less)) for i, c in enumerate(_CLASS)]
    return F.when(F.col(_CLASS[less]) > 0, F.concat_ws(",", *counts))


def _cells(words: DataFrame) -> DataFrame:
    """(cell, guest, word, n): every word in its own cell and as a guest where it may meet near words."""
    keyed = _blocks(words).withColumn("block", F.concat_ws(",", *_CLASS))
    length = sum((F.col(c) for c in _CLASS), F.lit(0))
    sizes = stored(keyed.groupBy("block", *_CLASS).agg(F.count("*").alias("size")), "blocks")
    # long words make smaller parts
    room = F.greatest(F.lit(1), F.floor(F.lit(PART * 32) / F.greatest(F.lit(32), length)))
    homes = sizes.select(F.col("block").alias("home"), F.ceil(F.col("size") / room).cast("int").alias("parts"))
    moves = [_moved(i) for i in range(CLASSES)] + [_moved(i, j) for i in range(CLASSES) for j in range(i)]
    visits = sizes.select("block", F.explode(F.array_compact(F.array(F.col("block"), *moves))).alias("home"))
    visits = stored(visits.join(homes, "home"), "visits")
    part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    met = keyed.select("block", "word", "n").join(visits, "block")
    own = F.col("block") == F.col("home")
    # a block's later parts are guests of its earlier ones
    met = met.withColumn("mine", F.when(own, part)).withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("mine", F.col("parts") - 1))))
    return met.select(F.concat_ws("/", "home", "part").alias("cell"), (~F.col("part").eqNullSafe(F.col("mine"))).alias("guest"), "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) for ``words`` (word, n): how many are one edit away, and the most frequent of them."""
    cells = _cells(words).repartition("cell").sortWithinPartitions("cell", "guest")
    found = cells.mapInArrow(_solve, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form), whose chains end: what is reached from each word by following them."""
    state = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "forms")
    while state.where("moved").limit(1).count():
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = stored(state.drop("moved").join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    return state.select("word", "root")


def variants(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``docs``."""
    words = stored(word_counts(docs, text, ident), "words")
    near = stored(near_words(words), "near")
    leads = F.col("best_n") >= 2 * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", F.when(leads, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(leads, F.col("best_n")).alias("form_n"))
    found = stored(found, "formed")
    ends = roots(found.where("form is not null").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
