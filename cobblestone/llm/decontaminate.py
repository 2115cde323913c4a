"""Benchmark decontamination with SimHash windows, in DataFrame operations only.

Texts become lower-case words without ASCII punctuation, and 64-bit hashes of their five-word shingles. For each benchmark
item of L words, windows of L words of a document are fingerprinted (SimHash over the window's shingles) and looked up in
a multi-index: of four blocks of 16 bits one at least differs in at most ``RADIUS // 4`` = 4 bits when the fingerprints
differ in at most ``RADIUS`` = 19. Every item is entered under each block value within 4 bits of its own (2,517 a block), so
an equi-join on (L, block, value) meets all pairs within the radius, and some 15 in 100 of the others. Pairs within it are
verified by the exact weighted similarity of their shingles, ``sum of least / sum of greatest`` multiplicity, at 0.8 or more.

Windows are laid only where they share a shingle with some item (aligned so that the shared shingle has the same place in
both): any other window has similarity 0 and could not be verified, so nothing is lost by leaving it out. Two texts with
similarity 0.8 differ in about 10 of 64 bits; the radius of 19 lies over three standard deviations above that.

The tables made of the benchmark are written first: Spark knows their size and broadcasts them only if they are small.
Documents without any shared shingle end after one scan; no text is shuffled but those of documents that share one. The
index is asked once for each different (L, fingerprint), so a passage that a third of all documents hold is one question.

Nulls: a null text or item has no words and never matches; items of fewer than five words are no evidence and never match.
Repeated items are reported each; repeated rows of documents too. Either table may be empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cobblestone.llm.common import stored, text_key, whole

SHINGLE = 5
RADIUS = 19
BLOCKS = 4
_WIDTH = 64 // BLOCKS
#: Block values within reach of 0; one block at least of two fingerprints within ``RADIUS`` differs by one of them.
_NEAR = [m for m in range(1 << _WIDTH) if m.bit_count() <= RADIUS // BLOCKS]
THRESHOLD = 0.8
_LONG = "bigint"


def shingles(frame: DataFrame, text: str, name: str) -> DataFrame:
    """``frame`` with the shingle hashes of a text, in order, in place of the text."""
    plain = F.array_remove(F.split(F.lower(whole(text)), r"[\s\p{Punct}]+"), "")
    frame = frame.withColumn("_codes", F.transform(plain, lambda w: F.xxhash64(w)))
    hashed = F.transform(
        F.sequence(F.lit(1), F.size("_codes") - (SHINGLE - 1)),
        lambda i: F.xxhash64(*(F.element_at("_codes", i + j) for j in range(SHINGLE))),
    )
    none = F.array().cast(f"array<{_LONG}>")
    return frame.withColumn(name, F.when(F.size("_codes") >= SHINGLE, hashed).otherwise(none)).drop("_codes", text)


def simhash(column: str) -> Column:
    """64 bits: a bit is set if it is set in more than half of the values of an array."""

    def bit(b: Column) -> Column:
        ones = F.aggregate(
            column, F.lit(0), lambda n, x: n + F.call_function("getbit", x, b).cast("int")
        )
        return F.when(2 * ones > F.size(column), F.call_function("shiftleft", F.lit(1).cast(_LONG), b)).otherwise(F.lit(0).cast(_LONG))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast(_LONG), lambda out, b: out.bitwiseOR(bit(b)))


def _blocks(frame: DataFrame) -> DataFrame:
    """A row per block of the fingerprint ``fp``: (block, value)."""
    values = [F.shiftrightunsigned("fp", _WIDTH * i).bitwiseAND((1 << _WIDTH) - 1) for i in range(BLOCKS)]
    return frame.select("*", F.posexplode(F.array(*values)).alias("block", "value"))


def _index(unique: DataFrame) -> DataFrame:
    """(content, length, goal, block, value): every item under all block values within reach of its own."""
    near = F.lit(_NEAR).cast(f"array<{_LONG}>")
    entries = _blocks(unique.select("content", "length", F.col("fp").alias("goal"), "fp"))
    around = F.transform(near, lambda m: F.col("value").bitwiseXOR(m))
    return entries.select("content", "length", "goal", "block", F.explode(around).alias("value"))


def similarity(a: str, b: str) -> Column:
    """Weighted Jaccard similarity of two shingle arrays; weights are multiplicities."""

    def count(column: str, x: Column) -> Column:
        return F.size(F.filter(column, lambda y: y == x))

    either = F.array_distinct(F.concat(a, b))
    least = F.aggregate(either, F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    return least / (F.size(a) + F.size(b) - least)


def matches(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", threshold: float = THRESHOLD) -> DataFrame:
    """(k, item, similarity, first_word): benchmark items found in the texts with key ``k``, a row per text and item."""
    # items by content, so that repeated ones are compared once
    goal = items.select(F.col(item).alias("item"), F.col("text").alias("body"), text_key("text").alias("content"))
    unique = shingles(goal.select("content", "body").dropDuplicates(["content"]), "body", "own")
    unique = stored(unique.withColumn("length", F.size("own")).withColumn("fp", simhash("own")), "items").where("length > 0")
    # where a window is laid depends on length and place only: items that share a shingle there are one row of the joins
    seeds = stored(unique.select("length", F.posexplode("own").alias("place", "s")).distinct(), "seeds")
    known = stored(seeds.select("s").distinct(), "shared")
    texts = docs.select(text_key(text).alias("k"), F.col(text).alias("body"))
    # outer, since Spark would push the filter that a plain explode brings below the shingles and compute them per element
    scanned = shingles(texts, "body", "own").select("k", F.explode_outer("own").alias("s"))
    touched = stored(scanned.join(known, "s", "left_semi").select("k").distinct(), "touched")
    near = texts.join(touched, "k", "left_semi").dropDuplicates(["k"])
    near = stored(shingles(near, "body", "own"), "near")
    hits = near.select("k", F.size("own").alias("n"), F.posexplode("own").alias("at", "s")).join(seeds, "s")
    start = F.col("at") - F.col("place")
    spots = hits.select(
        "k", "length", F.greatest(start, F.lit(0)).alias("first"), F.least(start + F.col("length"), F.col("n")).alias("last")
    ).distinct()
    windows = spots.join(near, "k").select(
        "k", "length", "first", F.slice("own", F.col("first") + 1, F.col("last") - F.col("first")).alias("part")
    )
    windows = stored(windows.withColumn("fp", simhash("part")), "windows")
    index = stored(_index(unique), "index")
    asked = _blocks(windows.select("length", "fp").distinct()).join(index, ["length", "block", "value"])
    asked = asked.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("goal"))) <= RADIUS)
    # written before it meets the windows: many of them may have one fingerprint, and Spark can split a hot key of a table
    answers = stored(asked.select("length", "fp", "content").distinct(), "answers")
    pairs = windows.join(answers, ["length", "fp"])
    verified = pairs.join(unique.select("content", "own"), "content")
    verified = verified.withColumn("similarity", similarity("part", "own")).where(F.col("similarity") >= threshold)
    best = verified.groupBy("k", "content").agg(F.max(F.struct("similarity", (-F.col("first")).alias("back"))).alias("b"))
    return best.join(goal.select("content", "item"), "content").select(
        "k", "item", F.col("b.similarity").alias("similarity"), (-F.col("b.back")).alias("first_word")
    )


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", ident: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(ident, item, similarity, first_word) for every document that holds a benchmark item."""
    found = matches(docs, items, text, item)
    named = docs.select(F.col(ident).alias("_id"), text_key(text).alias("k"))
    return named.join(found, "k").select(F.col("_id").alias(ident), F.col("item").alias(item), "similarity", "first_word")


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    bad = stored(matches(docs, items, text).select(F.col("k").alias("_bad")).distinct(), "contaminated")
    return docs.join(bad, text_key(text) == bad["_bad"], "left_anti")
