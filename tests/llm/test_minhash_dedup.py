"""Near-duplicates by bottom-k sketches against brute force over all pairs of shingle sets."""

import random
import re

import pytest

import corpus_pipeline
from cobblestone.llm import minhash_dedup
from cobblestone.llm.common import table, text_key

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text, size=5):
    words = WORD.findall((text or "").translate(FOLD))
    return frozenset(" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute_components(texts, num, den):
    """A label for every different set; equal sets have one."""
    sets = sorted({shingle_set(t) for t in texts}, key=sorted)
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and den * min(len(x), len(y)) >= num * max(len(x), len(y)) and den * len(x & y) >= num * len(x | y):
                parent[root(i)] = root(j)
    return {s: root(i) for i, s in enumerate(sets)}


def edited(seed=5):
    """Chains of edits near the threshold around a few long and short texts, and texts that share half of their words."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(400)
    texts = [None, "", " \n", "One", "one", "a b c d", "a b c d e", "A B c d e", None]
    common = [word() for _ in range(40)]
    for n in (12, 30, 49, 60, 120, 400):
        base = [word() for _ in range(n)]
        texts.append(" ".join(base))
        for changes in (1, 1, 2, 2, 3, 5, 8):
            for start in (base, texts[-1].split()):
                new = list(start)
                for _ in range(changes):
                    new[rng.randrange(len(new))] = "x%d" % rng.randrange(10**6)
                texts.append("  ".join(new))
        texts.append(" ".join(base + [word() for _ in range(n // 4)]))
        texts += [" ".join(base[k:]) for k in (1, 2, n // 8)]
    texts += [" ".join(common + [word() for _ in range(m)]) for m in (4, 8, 10, 12, 40) for _ in range(4)]
    return texts


def groups(pairs):
    out = {}
    for key, member in pairs:
        out.setdefault(key, set()).add(member)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("similarity, block, rounds", [((85, 100), 1024, 2), ((4, 5), 1024, 2), ((4, 5), 2, 1), ((85, 100), 3, 0)])
def test_links_equal_brute_force(spark, similarity, block, rounds, monkeypatch):
    """Also where lists are cut into small blocks, and where no round came before."""
    monkeypatch.setattr(minhash_dedup, "ROUNDS", rounds)
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    texts = edited()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = minhash_dedup.near_duplicates(docs, similarity=similarity).collect()
    brute = brute_components(texts, *similarity)
    assert groups((r.component, r.doc_id) for r in got) == groups((brute[shingle_set(t)], i) for i, t in enumerate(texts))


def test_result_of_the_query(spark):
    """Ids, set sizes, texts without words, nulls, repeated rows and columns with clashing names."""
    texts = edited()
    rows = [(None if i == 20 else i // 2 * 3, t, 1, "x") for i, t in enumerate(texts + texts[:12])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, node int, component string")
    brute, least = brute_components(texts, 85, 100), {}
    for ident, text, *_ in rows:
        key = brute[shingle_set(text)]
        if ident is not None:
            least[key] = min(least.get(key, ident), ident)
    want = []
    for ident, text, *_ in rows:
        first = least.get(brute[shingle_set(text)]) if shingle_set(text) else ident
        want.append((ident, len(shingle_set(text)), first, ident == first))
    got = [tuple(r) for r in minhash_dedup.linked(docs).collect()]
    order = lambda x: tuple((v is None, v) for v in x)
    assert sorted(got, key=order) == sorted(want, key=order)


def test_empty_table(spark):
    assert minhash_dedup.linked(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    one = spark.createDataFrame([(1, "w " * 200_000)], "doc_id bigint, text string")
    assert [tuple(r) for r in minhash_dedup.linked(one).collect()] == [(1, 1, 1, True)]


def test_the_stage_keeps_one_document_a_group(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    rows = docs.select("doc_id", "text", text_key().alias("k")).collect()
    brute = brute_components([r.text for r in rows], 4, 5)
    first = {}
    for r in rows:
        key, name = brute[shingle_set(r.text)], (r.doc_id is None, r.doc_id, r.k)
        first[key] = min(first.get(key, name), name)
    kept = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(n[1] for n in first.values())


def written_pairs(spark, texts, monkeypatch):
    seen, confirmed = [], minhash_dedup._confirmed
    with monkeypatch.context() as patch:
        patch.setattr(minhash_dedup, "_confirmed", lambda pairs, *more: seen.append(pairs.distinct().count()) or confirmed(pairs, *more))
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        found = minhash_dedup.near_duplicates(docs, similarity=(4, 5)).collect()
    return len({r.component for r in found}), sum(seen)


def test_a_group_of_near_copies_is_not_paired_up(spark, monkeypatch):
    n, base = 300, ["w%d" % i for i in range(100)]
    texts = [" ".join(base[: i % 90] + ["e%d" % i] + base[i % 90 + 1 :]) for i in range(n)]
    components, pairs = written_pairs(spark, texts, monkeypatch)
    # what a node meets in the rounds, whatever the size of the group; all pairs are n * n / 2
    assert components == 1 and pairs <= minhash_dedup.ROUNDS * minhash_dedup.MEETS * n


def test_texts_of_common_sentences_are_not_paired_up(spark, monkeypatch):
    """No two are similar, and every shingle is in a fifth of the texts: pairs are dropped before they are written."""
    rng = random.Random(9)
    sentences = [[f"s{k}w{i}" for i in range(12)] for k in range(30)]
    n, chosen = 400, []
    while len(chosen) < n:
        new = rng.sample(range(30), 6)
        if all(len(set(new) & set(old)) < 5 for old in chosen):
            chosen.append(new)
    texts = [" ".join(" ".join(sentences[k]) for k in x) for x in chosen]
    components, pairs = written_pairs(spark, texts, monkeypatch)
    assert components == n and pairs < 2 * n


def test_chance_of_a_loss_is_bounded():
    for num, den in ((85, 100), (4, 5)):
        least = minhash_dedup.least_shared(48, num, den)
        rng = random.Random(1)
        shared = [sum(rng.random() < num / den for _ in range(48)) for _ in range(20_000)]
        assert least < min(shared)
