"""The whole pipeline against an independent version in plain Python, stage by stage, on the smallest tables."""

import collections
import os
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cobblestone.llm.common import stored, table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def quality(rows):
    def failed(t):
        w = words(t)
        at = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if at[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        return len(w) < 20 or 100 * len(again) > 30 * len(w)

    hosts = collections.defaultdict(list)
    for r in rows:
        hosts[r["source"]].append(failed(r["text"]))
    raw = [sum(f) / len(f) for f in hosts.values()]
    m = sum(raw) / len(raw)
    v = sum((x - m) ** 2 for x in raw) / len(raw)
    s = 1e6 if v * 1e6 <= m * (1 - m) else max(1.0, min(1e6, m * (1 - m) / v - 1))
    good = {h for h, f in hosts.items() if (sum(f) + m * s) / (len(f) + s) <= 0.5}
    return [r for r in rows if r["source"] in good and not failed(r["text"])]


def near_duplicates(rows):
    def shingles(t):
        w = words((t or "").translate(FOLD))
        return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets, parent = [shingles(r["text"]) for r in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                a, b = sorted((root(i), root(j)), key=lambda k: rows[k]["doc_id"])
                parent[b] = a
    return [r for i, r in enumerate(rows) if root(i) == i]


def repeated_passages(rows, size=35):
    seen = collections.Counter(tuple(w[i : i + size]) for w in (words(r["text"]) for r in rows) for i in range(len(w) - size + 1))
    out = []
    for r in rows:
        w = words(r["text"])
        gone = {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        if gone and len(gone) < len(w):
            text = " ".join(x for i, x in enumerate(w) if i not in gone)
            out.append(r | {"text": text, "n_chars": len(text)})
        elif not gone:
            out.append(r)
    return out


def decontaminated(rows, items):
    plain = lambda t: [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", (t or "").lower()) if w]
    grams = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    goals = [(grams(plain(t)), len(plain(t))) for t in items]

    def holds(w):
        every = set(grams(w))
        for goal, n in goals:
            if goal and not every.isdisjoint(goal):
                for s in range(-n, len(w)):
                    got = grams(w[max(0, s) : max(0, s + n)])
                    if got and sum((got & goal).values()) >= 0.8 * sum((got | goal).values()):
                        return True
        return False

    return [r for r in rows if not holds(plain(r["text"]))]


def test_stages_equal_their_plain_versions(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    rng = random.Random(11)
    planted = []
    first = [r.asDict() for r in docs.collect()]
    long = [r for r in first if len(words(r["text"])) > 150][:12]
    for i, r in enumerate(long):  # near copies, leaks and shared passages beside those of the table
        w = words(r["text"])
        w[rng.randrange(len(w))] = "edited"
        planted.append(r | {"doc_id": 10_000 + i, "text": " ".join(w)})
        planted.append(r | {"doc_id": 20_000 + i, "text": " ".join(words(long[i - 1]["text"])[20:70] + [f"own{i}x{k}" for k in range(60)])})
        planted.append(r | {"doc_id": 30_000 + i, "text": " ".join(f"lead{i}x{k}" for k in range(30)) + " " + items[i] + " tail"})
    every = stored(docs.unionByName(spark.createDataFrame(planted, docs.schema)), "planted")
    rows = [r.asDict() for r in every.collect()]
    plain = [quality, near_duplicates, repeated_passages, lambda x: decontaminated(x, items)]
    told = lambda x: sorted(tuple(r[c] for c in columns) for r in x)
    for (name, stage), version in zip(corpus_pipeline.STAGES, plain):
        before, rows = len(rows), version(rows)
        every = stored(stage(spark, every, SF), name)
        assert every.columns == columns and told(every.collect()) == told(rows), name
        assert name == "repeated_passages" or len(rows) < before, name
    mixed = corpus_pipeline.STAGES[-1][1](spark, every, SF)
    sizes = {r["doc_id"]: len(words(r["text"])) for r in rows}
    taken, of = collections.Counter(), collections.Counter()
    for r in mixed.collect():
        assert 1 <= r.copies <= 3 and r.doc_id in sizes
        taken[r.source] += r.copies * sizes[r.doc_id]
    for r in rows:
        of[r["source"]] += sizes[r["doc_id"]]
    target, free, left = {}, dict(zip(sorted(of), [1, 2, 3] * len(of))), float(sum(of.values()))
    while free:  # shares by weight, the excess over three times a source's size going to the others
        share = {s: left * k / sum(free.values()) for s, k in free.items()}
        full = [s for s in free if share[s] >= 3 * of[s]] or list(free)
        capped = share[full[0]] >= 3 * of[full[0]]
        for s in full:
            target[s] = 3.0 * of[s] if capped else share[s]
        left -= sum(target[s] for s in full)
        free = {s: k for s, k in free.items() if s not in target}
    for s in of:
        assert taken[s] == pytest.approx(target[s], rel=0.1, abs=400), s
    assert mixed.where(F.col("copies") < 1).count() == 0
