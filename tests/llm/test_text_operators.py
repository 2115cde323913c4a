"""Text operators against brute force on small fixtures, with the odd cases: nulls, empties, ties, repeats, extra columns."""

import collections
import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from cobblestone.llm import decontaminate, license_scan, mixing, quality_rules, simhash_dedup, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, fp string, k string, marks int"


def corpus(seed=3, n=60):
    """Texts with copies, edits, shared passages, long and short ones, nulls and repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)] + ["Äther", "naïve", "語", "x" * 90]
    text = lambda m: rng.choice([" ", "\n", "  ", "\t"]).join(rng.choice(vocabulary) for _ in range(m))
    shared = [" ".join(rng.choice(vocabulary) for _ in range(m)) for m in (34, 35, 36, 60)]
    texts = [text(rng.choice([0, 1, 2, 5, 20, 50, 120])) for _ in range(n)]
    texts += [t + " " + rng.choice(shared) + "\n" + text(5) for t in texts[:25]]
    texts += texts[:6] + [None, "", " \n ", None, "one", "one"]
    near = texts[-20].split()
    for i in range(8):
        near = list(near) or ["a"]
        near[rng.randrange(len(near))] = "edit%d" % i
        texts.append(" ".join(near))
    texts.append(" ".join(shared[1].split() * 5))
    texts.append(" ".join(rng.choice(vocabulary) for _ in range(20_000)))
    rows = [(i if i % 17 else None, t, None, "s%d" % (i % 3) if i % 5 else None, None, 7, "x", "y", 1) for i, t in enumerate(texts)]
    return rows + rows[3:5]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def counted(rows):
    return collections.Counter(tuple(r) for r in rows)


def test_substring_dedup_equals_brute_force(docs):
    rows, size = docs.select("doc_id", "text").collect(), 35
    seen = collections.Counter(tuple(w[i : i + size]) for w in (words(r.text) for r in rows) for i in range(len(w) - size + 1))
    want = []
    for r in rows:
        w = words(r.text)
        gone = {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((r.doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = substring_dedup.remove_recurring(docs, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert counted(got.collect()) == counted(want)
    assert any(w[2] for w in want)


@pytest.mark.parametrize("size,gram", [(4, 2), (6, 6), (9, 3)])
def test_substring_dedup_with_small_windows(spark, size, gram):
    rng = random.Random(size)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(30))) for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    seen = collections.Counter(tuple(w[i : i + size]) for w in map(words, texts) for i in range(len(w) - size + 1))
    for r in substring_dedup.remove_recurring(frame, size=size, gram=gram).collect():
        w = words(texts[r.doc_id])
        gone = {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        assert r.n_removed == len(gone)
        assert r.kept_text == (" ".join(x for i, x in enumerate(w) if i not in gone) if gone else None)


def fingerprint(text, size=3):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, ids, radius=3):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, ident in enumerate(ids):
        if ident is not None:
            least[find(i)] = min(least.get(find(i), ident), ident)
    return [least.get(find(i)) for i in range(len(prints))]


def test_simhash_equals_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [fingerprint(r.text) for r in rows]
    want = list(zip([r.doc_id for r in rows], prints, brute_components(prints, [r.doc_id for r in rows])))
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash_dedup.near_duplicates(docs).collect()]
    assert counted(got) == counted(want)


@pytest.mark.parametrize("shard", [4096, 16])
def test_bk_trees_lose_no_link(spark, shard):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for p in list(prints[:30]):
        for _ in range(rng.randrange(8)):
            prints.append(p := p ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))))
    hot = rng.getrandbits(64)
    prints = list(dict.fromkeys(prints + [hot ^ rng.getrandbits(7) for _ in range(120)]))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p, i) for i, p in enumerate(signed)], "fp bigint, i bigint")
    pairs = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash_dedup.links(frame.select("fp"), shard=shard).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in pairs)
    place = {p: i for i, p in enumerate(prints)}
    label = list(range(len(prints)))
    for _ in prints:
        for a, b in pairs:
            label[place[a]] = label[place[b]] = min(label[place[a]], label[place[b]])
    assert label == brute_components(prints, list(range(len(prints))))


def test_quality_counts_equal_brute_force(docs):
    for r in quality_rules.judge(docs).collect():
        t, w = r.text or "", words(r.text)
        at = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeated = {j for i in range(len(w) - 7) if at[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(w) < 20 or 100 * len(repeated) > 30 * len(w))
        assert not (r.kept and r.base_failed)


def test_hosts_that_mostly_fail_lose_their_good_documents(spark):
    good = " ".join("w%d" % i for i in range(40))
    rows = [(i, "short" if i % 10 else good, "bad") for i in range(100)] + [(i, good, h) for i in range(100, 160) for h in ("a", None)]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert {r.source for r in got if r.kept} == {"a", None}
    assert all(0 < r.host_rate < 1 for r in got)


def test_decontamination_equals_brute_force(spark, docs):
    rng = random.Random(8)
    items = [(i, " ".join("b%d" % rng.randrange(50) for _ in range(n)) + "!") for i, n in enumerate((5, 6, 12, 30, 30, 4, 0))] + [(7, None), (8, None)]
    items.append((9, items[3][1]))
    texts = [(1000 + i, f"lead in, {t.upper()} -- and out") for i, t in items if t]
    long = items[3][1].split()
    texts += [(2000, " ".join(["x"] * 3 + long[:20] + ["y"] + long[21:])), (2001, " ".join(long[:15])), (2002, " ".join(long[:14] + long[15:]))]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id bigint, text string"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")

    def plain(t):
        return [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", (t or "").lower()) if w]

    def grams(w):
        return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    want = set()
    for r in frame.collect():
        w = plain(r.text)
        for i, t in items:
            goal = grams(plain(t))
            n = len(plain(t))
            if not goal or len(w) < 5 or not goal.keys() & grams(w).keys():
                continue
            best = 0.0
            for s in range(-n, len(w)):
                got = grams(w[max(0, s) : max(0, s + n)])
                if got:
                    best = max(best, sum((got & goal).values()) / sum((got | goal).values()))
            if best >= 0.8:
                want.add((r.doc_id, i, round(best, 9)))
    got = {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in decontaminate.contaminated(frame, bench).collect()}
    assert got == want and {w[0] for w in want} >= {1000, 1001, 1002, 1003, 1004}
    left = {r.doc_id for r in decontaminate.clean(frame, bench).collect()}
    assert left == {r.doc_id for r in frame.collect()} - {w[0] for w in want}


def test_mix_meets_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * min(3000, int(rng.lognormvariate(4, 1)))), rng.choice(["a", "a", "a", "b", "c", "ä", None])) for i in range(900)]
    rows += [(1000, None, "empty"), (1001, "", "empty"), (None, "one two", "b"), (5, "one two", "b"), (5, "one two", "b")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(7)
    got = mixing.mix_sources(frame).select("doc_id", "size", "source", "source_size", "target", "rate", "copies").collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:  # shares by weight, the excess over three times a source's size going to the others
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] >= 3 * sizes[s]}
        if not full:
            target.update(share)
            break
        for s in full:
            target[s], left = 3.0 * sizes[s], left - 3.0 * sizes[s]
        free -= full
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.copies <= 3 and r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.copies * r.size
    for s in order:
        assert taken[s] == pytest.approx(target[s], rel=0.01, abs=3)
    again = mixing.mix_sources(frame.repartition(3)).select("doc_id", "size", "source", "source_size", "target", "rate", "copies").collect()
    assert counted(got) == counted(again)


def test_newton_balances_two_margins(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("a", "y", 30), ("b", "x", 20), ("b", "y", 5), ("c", "x", 0)], "s string, l string, size bigint")
    goals = {
        "s": spark.createDataFrame([("a", 20.0), ("b", 40.0), ("c", 0.0)], "s string, target double"),
        "l": spark.createDataFrame([("x", 35.0), ("y", 25.0)], "l string, target double"),
    }
    dual = mixing.multipliers(cells, goals)
    mass = {(r.s, r.l): r["size"] * 2.718281828459045 ** (dual["s"][r.s] + dual["l"][r.l]) for r in cells.where("size > 0").collect()}
    assert sum(v for k, v in mass.items() if k[0] == "a") == pytest.approx(20) and sum(v for k, v in mass.items() if k[1] == "y") == pytest.approx(25)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_license_spans_and_coverage(spark):
    mit = license_scan.TEMPLATES["MIT-text"].split()
    edited = " ".join(mit[:20] + ["really", "indeed"] + mit[20:50] + mit[52:])
    texts = [
        "Code.\n// Released under the MIT License. See more", edited, "the license of the license", None, "", "x " * 5000 + "Licensed under CC BY-NC 4.0.",
        "Licensed under the Apache License, Version 2.0. released UNDER the mit license",
    ]
    frame = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id bigint, text string, license string")
    got = {}
    for r in license_scan.scan(frame).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert {d: {r.license for r in rs} for d, rs in got.items()} == {0: {"MIT-notice"}, 1: {"MIT-text"}, 5: {"CC-BY-NC-4.0-short"}, 6: {"Apache-2.0-notice", "MIT-notice"}}
    first = got[0][0]
    assert texts[0].encode()[first.first_byte : first.last_byte].decode() == "Released under the MIT License" and first.coverage == 1.0
    tokens = lambda t: re.findall(r"[0-9a-z]+", t.lower())
    assert got[1][0].matched_words == lcs(tokens(license_scan.TEMPLATES["MIT-text"]), tokens(edited))


def test_empty_tables(spark, nothing):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert substring_dedup.remove_recurring(nothing).count() == 0
    assert simhash_dedup.near_duplicates(nothing).count() == 0
    assert quality_rules.judge(nothing).count() == 0
    assert mixing.mix_sources(nothing).count() == 0
    assert license_scan.scan(nothing).count() == 0
    assert decontaminate.contaminated(nothing, bench).count() == 0
    assert decontaminate.clean(nothing, bench).columns == nothing.columns


def test_extra_columns_stay(docs):
    kept = quality_rules.judge(docs)
    assert set(docs.columns) <= set(kept.columns)
    assert set(docs.columns) - {"text", "k", "marks"} <= set(substring_dedup.remove_recurring(docs, digest=True).columns)
    assert docs.select(F.count("*")).first()[0] == kept.count()


def test_blocks_reach_every_fingerprint_within_the_radius():
    rng, width = random.Random(4), 64 // decontaminate.BLOCKS
    near = set(decontaminate._NEAR)
    for _ in range(2000):
        apart = sum(1 << b for b in rng.sample(range(64), decontaminate.RADIUS))
        assert any(apart >> (width * i) & ((1 << width) - 1) in near for i in range(decontaminate.BLOCKS))


def test_edits_at_the_threshold_are_found(spark):
    """One changed word in items of 49 to 59 words (similarity 0.80 to 0.84): at most one in a hundred may be lost."""
    rng = random.Random(6)
    items, texts = [], []
    for i in range(200):
        words = ["w%d" % rng.randrange(10**6) for _ in range(rng.randrange(49, 60))]
        items.append((i, " ".join(words)))
        words[rng.randrange(5, len(words) - 5)] = "changed"
        texts.append((i, " ".join(["before"] * 30 + words + ["after"] * 30)))
    found = decontaminate.contaminated(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    hits = {(r.doc_id, r.item_id) for r in found.collect()}
    assert all(a == b for a, b in hits) and len(hits) >= 198
