"""Host-level quality rules.

Every document gets counts from its whole text and a verdict of the document rules. Failures are then added up per host;
the failure rate of a host is shrunk towards all hosts with a beta prior whose mean and strength come from the hosts
themselves (method of moments), and the verdict on the host is joined back to its documents.

Nulls: a null text has no words (and fails), a null host is a host of its own. Repeated rows count as often as they occur.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cobblestone.llm.common import map_batches, stored
from cobblestone.llm.words import Words, mix, words_of

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
#: A host goes when its shrunk share of failing documents is above this.
MAX_HOST_RATE = 0.5

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

METRICS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def _per_document(at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the sorted positions ``at`` lie in each range of ``offsets``."""
    return np.diff(np.searchsorted(at, offsets))


def _repeated_words(words: Words, size: int) -> np.ndarray:
    """Words covered by windows of ``size`` words that occur twice or more in their document."""
    at = words.windows(size)
    if not len(at):
        return np.zeros(words.docs, np.int64)
    owner = words.owner
    key = mix(words.spans(at, at + size) ^ mix(owner[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(words.begin) + 1, np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + size, -1)
    return np.bincount(owner[np.cumsum(step[:-1]) > 0], minlength=words.docs)


def _repeated_lines(words: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document."""
    out, raw = np.zeros(words.docs, np.int64), words.data.tobytes()
    for d in range(words.docs):
        lines = raw[words.offsets[d] : words.offsets[d + 1]].split(b"\n")
        if len(lines) > 1:
            filled = [line for line in lines if line.strip()]
            out[d] = len(filled) - len(set(filled))
    return out


def metrics_of(column: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for words in words_of(column):
        # every byte that is not a UTF-8 continuation starts a code point
        heads = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
        chars = np.concatenate([[0], np.cumsum(heads[words.end] - heads[words.begin])])
        yield words.first, words.docs, [
            words.counts,
            np.diff(chars[words.bounds]),
            _per_document(np.flatnonzero(SYMBOLS[words.data]), words.offsets),
            _repeated_lines(words),
            _repeated_words(words, REPEAT_WINDOW),
        ]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of its texts; columns of the same names are replaced."""
    names = [m.split()[0] for m in METRICS.split(", ")]
    rest = [f for f in docs.schema.fields if f.name not in names]
    place = [f.name for f in rest].index(text)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, count, columns in metrics_of(batch.column(place)):
            part = batch.slice(first, count)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *(pa.array(c.astype(np.int64)) for c in columns)], [f.name for f in rest] + names
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", " + METRICS
    return map_batches(docs.select(*(F.col(f"`{f.name}`") for f in rest)), run, schema)


def fails() -> Column:
    """The document rules: too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_verdicts(measured: DataFrame, host: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n_docs, n_failed, host_rate, host_kept): rates shrunk by an empirical beta prior.

    With m and v the mean and the variance of the hosts' raw rates the prior has strength ``m (1 - m) / v - 1``, held in
    1 .. 10^6; without any spread it is the upper end. One row per host; sums are combined before the shuffle.
    """
    hosts = measured.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n_docs"), F.count_if(fails()).alias("n_failed")
    ).withColumn("raw", F.col("n_failed") / F.col("n_docs"))
    hosts = stored(hosts, "host-sums")  # read twice, for the prior and for the rates
    prior = hosts.agg(F.avg("raw").alias("m"), F.coalesce(F.var_pop("raw"), F.lit(0.0)).alias("v"))
    strength = F.when(F.col("v") * 1e6 <= F.col("m") * (1 - F.col("m")), F.lit(1e6)).otherwise(
        F.col("m") * (1 - F.col("m")) / F.col("v") - 1
    )
    prior = prior.select("m", F.greatest(F.lit(1.0), F.least(F.lit(1e6), strength)).alias("strength"))
    rate = (F.col("n_failed") + F.col("m") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    # the prior is a single row
    return hosts.crossJoin(F.broadcast(prior)).select(
        "host", "n_docs", "n_failed", rate.alias("host_rate"), (rate <= max_rate).alias("host_kept")
    )


def judge(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``docs`` with counts, ``base_failed``, ``host_rate`` and ``kept``.

    The texts are read twice (once for the host sums) rather than carried through a shuffle: hosts are few, so the join
    back is by a table of one row per host, and a hot host is split by Spark's skew join where that table is large.
    """
    verdicts = host_verdicts(measure(docs.select(F.col(text).alias("text"), F.col(host).alias("host"))), "host", max_rate)
    # written, so that Spark knows its size before it plans the join
    verdicts = stored(verdicts.select(F.col("host").alias("_host"), "host_rate", "host_kept"), "hosts")
    rest = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("host_rate", "host_kept", "base_failed", "kept")))
    measured = measure(rest, text).withColumn("base_failed", fails())
    joined = measured.join(verdicts, measured[f"`{host}`"].eqNullSafe(verdicts["_host"]), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).drop(verdicts["_host"]).drop("host_kept")
