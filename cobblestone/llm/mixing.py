"""Mixing of sources to target weights by entropy balancing.

Every document gets a rate (expected copies). Of all rates that bring each margin, such as a source, to its target number
of tokens, entropy balancing takes those nearest to one in relative entropy, tokens being the base measure. By duality
they are exponentially tilted: ``rate = exp(sum of the multipliers of the document's margin values)``, and the multipliers
minimise a convex function, found by Newton steps. Gradient and Hessian of each step are sums over the corpus, taken by
Spark over cells (different combinations of margin values with their tokens, combined once).

Rates become whole copies by error diffusion: the documents of a source are spread by a hash of the whole row over bounded
chunks (rows that are repeated as a whole in turn, so that copies of one text spread as well), and a chunk takes its documents from the longest to the shortest, handing the tokens rounded away on to the next, so that the
short ones settle the account. Copies are at most ``cap`` per document.

Nulls: a null text has size 0, a null margin value is a value of its own. Repeated rows are mixed one by one. Results
depend on the rows only, not on their order. Size-0 documents get the rate of their source and take nothing. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from cobblestone.llm.common import map_batches, stored, text_key
from cobblestone.llm.words import words_of

CAP = 3
#: A chunk has about so many documents and words at most.
CHUNK = 16_384
CHUNK_WORDS = 4_000_000
RESERVED = ("size", "salt", "source_size", "target", "rate", "copies", "n_docs", "_text", "_s", "_parts", "_part", "_order", "_times", "_turn", "_v", "_x")
#: The Newton system holds a number per margin value and pair of values seen together; more than this is an error.
MAX_CONSTRAINTS = 4096


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``size`` in words and ``salt``, a hash of the text."""
    rest = [f for f in docs.schema.fields if f.name not in (text, "size", "salt")]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for words in words_of(batch.column(0)):
            part = batch.slice(words.first, words.docs)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array(words.counts.astype(np.int64))], ["salt", *(f.name for f in rest), "size"]
            )

    schema = "salt bigint, " + "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest) + "size bigint"
    return map_batches(docs.select(F.col(text).alias("_text"), text_key(text).alias("salt"), *(F.col(f"`{f.name}`") for f in rest)), run, schema)


def weighted_targets(totals: DataFrame, source: str = "source", cap: float = CAP) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, source_size, n_docs).

    Sources by code point, null last, weigh 1, 2, 3, 1, ... and share the whole size; none gets more than ``cap`` times
    its own, the excess going to the others by weight. That fixed point is ``least(cap * size, level * weight)`` with one
    common level: with the sources in the order of ``cap * size / weight``, those before some place are at their cap, and
    the level is what is left over the weights that are left. The windows see one row per source.
    """
    ranked = totals.withColumn("w", (F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1) % 3 + 1)
    ranked = ranked.withColumn("most", F.col("source_size") * float(cap)).withColumn("ratio", F.col("most") / F.col("w"))
    upto = Window.orderBy("ratio", F.col(source).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(upto), F.lit(0.0))) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0))
    )
    # the first source that the level of its place leaves below its cap fixes the common level
    ranked = ranked.withColumn("level", level)
    common = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)
    ranked = ranked.withColumn("common", common["level"])
    target = F.least(F.col("most"), F.coalesce(F.col("common"), F.lit(float("inf"))) * F.col("w"))
    return ranked.select(source, "source_size", "n_docs", target.alias("target"))


def multipliers(cells: DataFrame, targets: dict[str, DataFrame], steps: int = 60, tolerance: float = 1e-10) -> dict[str, dict]:
    """Newton's method on the dual. ``cells``: margin columns and ``size``; ``targets``: margin -> (value, target).

    Returns margin -> value -> multiplier. Values with no tokens or no target to reach keep no tokens (minus infinity).
    """
    margins = list(targets)
    cells = stored(cells.groupBy(*margins).agg(F.sum("size").alias("size")).where("size > 0"), "cells")
    names: list[tuple[str, object]] = []
    goal: list[float] = []
    for margin in margins:
        rows = targets[margin].select(margin, "target").limit(MAX_CONSTRAINTS + 1).collect()
        if len(rows) + len(names) > MAX_CONSTRAINTS:
            raise ValueError(f"more than {MAX_CONSTRAINTS} margin values")
        for value, target in rows:
            names.append((margin, value))
            goal.append(float(target))
    place, b = {name: i for i, name in enumerate(names)}, np.array(goal)
    dual = np.where(b > 0, 0.0, -np.inf)

    def step() -> tuple[np.ndarray, np.ndarray]:
        tilted, rate = cells, F.lit(0.0)
        for margin in margins:
            kind = cells.schema[margin].dataType.simpleString()
            rows = [(v, float(dual[place[m, v]])) for m, v in names if m == margin]
            table = cells.sparkSession.createDataFrame(rows, f"`_v_{margin}` {kind}, `_x_{margin}` double")
            # at most MAX_CONSTRAINTS rows
            tilted = tilted.join(F.broadcast(table), F.col(margin).eqNullSafe(F.col(f"_v_{margin}")))
            rate = rate + F.col(f"_x_{margin}")
        tilted = tilted.withColumn("mass", F.col("size") * F.exp(rate))
        total, curve = np.zeros(len(names)), np.zeros((len(names), len(names)))
        for i, m in enumerate(margins):
            for value, mass in tilted.groupBy(m).agg(F.sum("mass")).collect():
                total[place[m, value]] = curve[place[m, value], place[m, value]] = mass
            for other in margins[i + 1 :]:
                for u, v, mass in tilted.groupBy(m, other).agg(F.sum("mass")).collect():
                    x, y = place[m, u], place[other, v]
                    curve[x, y] = curve[y, x] = mass
        return total, curve

    for _ in range(steps if len(names) else 0):
        total, curve = step()
        live = (total > 0) & np.isfinite(dual)
        gap = np.where(live, total - b, 0.0)
        if np.all(np.abs(gap) <= tolerance * np.maximum(b, 1.0)):
            break
        move = np.linalg.lstsq(curve[np.ix_(live, live)], gap[live], rcond=1e-12)[0]
        dual[live] -= np.clip(move, -2.0, 2.0)  # damped far from the solution
    out: dict[str, dict] = {m: {} for m in margins}
    for (margin, value), x in zip(names, dual):
        out[margin][value] = float(x)
    return out


def _diffuse(size: np.ndarray, rate: np.ndarray, cap: int) -> np.ndarray:
    """Whole copies for documents in order of falling size."""
    copies, error = np.zeros(len(size), np.int64), 0.0
    base = np.floor(rate)
    for i, (n, whole, rest) in enumerate(zip(size.tolist(), base.tolist(), (rate - base).tolist())):
        if n == 0:
            copies[i] = min(cap, round(whole + rest))
            continue
        error += n * rest
        extra = max(-whole, min(cap - whole, np.floor(error / n + 0.5)))
        copies[i] = whole + extra
        error -= n * extra
    return copies


def dealt(sized: DataFrame, rates: DataFrame, source: str = "source", chunk: int = CHUNK) -> DataFrame:
    """The different rows of ``sized`` with rate, _order (a hash of the row), _s, _part (its chunk) and _times.

    A row that is repeated as a whole goes to the chunks in turn, so that no chunk depends on the number of its copies.
    """
    parts = F.greatest(F.ceil(F.col("n_docs") / F.lit(chunk)), F.ceil(F.col("source_size") / F.lit(CHUNK_WORDS))).cast("bigint")
    table = rates.select(F.col(source).alias("_s"), "rate", parts.alias("_parts"))
    # maps can be neither grouped nor hashed: their text stands for them
    maps = [f.name for f in sized.schema.fields if "map<" in f.dataType.simpleString()]
    told = [(F.to_json(F.struct(F.col(f"`{c}`"))) if c in maps else F.col(f"`{c}`")).alias(f"_m{i}" if c in maps else c) for i, c in enumerate(sized.columns)]
    first = [F.first(F.col(f"`{c}`")).alias(c) for c in maps]
    different = sized.groupBy(*told).agg(F.count("*").alias("_times"), *first)
    order = F.xxhash64(*(F.col(f"`_m{i}`" if c in maps else f"`{c}`") for i, c in enumerate(sized.columns)))
    different = different.select(*(F.col(f"`{c}`") for c in sized.columns), "_times", order.alias("_order"))
    # a row per source, at most MAX_CONSTRAINTS
    joined = different.join(F.broadcast(table), F.col(source).eqNullSafe(F.col("_s")))
    turns = F.sequence(F.lit(0).cast("bigint"), F.least("_times", "_parts") - 1)
    turned = joined.select("*", F.explode(turns).alias("_turn"))
    # of the copies 0 .. _times - 1 this chunk takes those that leave the remainder _turn; the hash is cut, so that it cannot overflow
    part = F.pmod(F.pmod("_order", "_parts") + F.col("_turn"), "_parts")
    times = F.ceil((F.col("_times") - F.col("_turn")) / F.col("_parts")).cast("bigint")
    return turned.withColumn("_part", part).withColumn("_times", times).drop("_turn", "_parts")


def copies(sized: DataFrame, rates: DataFrame, source: str = "source", cap: int = CAP, chunk: int = CHUNK) -> DataFrame:
    """``sized`` (source, size, salt, ...) with ``copies``; ``rates`` is (source, n_docs, source_size, rate), a row per source."""
    rows = dealt(sized, rates, source, chunk)
    helpers = ["_s", "_part", "_order", "_times"]

    def run(rows: pa.Table) -> pa.Table:
        keys = [("size", "descending"), ("salt", "ascending"), ("_order", "ascending")]
        order = pc.sort_indices(rows, sort_keys=keys).to_numpy()
        rows = rows.take(pa.array(np.repeat(order, rows["_times"].to_numpy()[order]))).drop_columns(helpers)
        taken = _diffuse(rows["size"].to_numpy(), rows["rate"].to_numpy(), cap)
        return rows.append_column("copies", pa.array(taken))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in helpers]
    return rows.groupBy("_s", "_part").applyInArrow(run, ", ".join(fields) + ", copies bigint")


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", cap: int = CAP) -> DataFrame:
    """``docs`` without its text, with size, salt, source_size, target, rate and copies.

    Columns of these names, and of the ``RESERVED`` ones, are replaced or left out.
    """
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c in (text, source) or c not in RESERVED))
    sized = sizes(docs, text)  # counted once for the totals and once for the copies, rather than written
    totals = sized.groupBy(source).agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = stored(weighted_targets(totals, source, cap), "targets")
    dual = multipliers(targets.select(source, F.col("source_size").alias("size")), {source: targets.select(source, "target")})[source]
    kind = targets.schema[source].dataType.simpleString()
    solved = targets.sparkSession.createDataFrame(list(dual.items()), f"_v {kind}, _x double")
    rate = F.least(F.lit(float(cap)), F.round(F.exp("_x"), 9))
    rates = targets.join(F.broadcast(solved), F.col(source).eqNullSafe(F.col("_v"))).select(source, "n_docs", "source_size", "target", rate.alias("rate"))
    done = copies(sized, rates, source, cap)
    known = rates.select(F.col(source).alias("_v"), "source_size", "target")
    return done.join(F.broadcast(known), F.col(source).eqNullSafe(F.col("_v"))).drop("_v")
