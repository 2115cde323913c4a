"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, strategies as st

from cobblestone.llm import spelling_variants as sv

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute(rows):
    fold = {c: c + 32 for c in range(65, 91)}
    counts = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(fold)):
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    close = {w: [v for v in words if abs(len(v) - len(w)) < 2 and near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(close[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(close[w]), words.get(form[w])) for w, n in words.items()}


def variants(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, word string, n int")
    return {tuple(r) for r in sv.variants(df, **more).select(*COLUMNS).collect()}


def corpus(seed=3):
    rng = random.Random(seed)
    letters = "abcdeéß÷Àz"
    stems = ["".join(rng.choices(letters, k=rng.randrange(4, 9))) for _ in range(40)]
    stems += ["aaaaa", "aaaaaa", "aaaaaaa", "aaaab", "AAAAA", "x" * 300, "x" * 299 + "y", "abcdef", "abcdfe", "fedcba"]
    edited = []
    for w in stems:
        for _ in range(3):
            i = rng.randrange(len(w))
            edited += [w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]]
    words = stems + edited
    rows = []
    for d in range(60):
        rows.append((d % 50, " ".join(rng.choices(words, weights=[1 + 30 / (1 + i % 17) for i in range(len(words))], k=120)) + "1,naïve_", "w", 1))
    return rows + [(None, "aaaaa aaaaab", "w", 1), (7, None, "w", 1), (8, "", None, None), (9, " 12 \n", None, 3)]


@pytest.mark.parametrize("part", [4096, 3])
def test_equal_to_brute_force(spark, part, monkeypatch):
    """Also with blocks cut into small parts, whose later parts are guests of the earlier ones."""
    rows = corpus()
    want = brute([r[:2] for r in rows])
    assert sum(x[1] is not None for x in want) > 20 and any(x[1] not in (None, x[2]) for x in want)
    monkeypatch.setattr(sv, "PART", part)
    assert variants(spark, rows) == want


def test_empty_table_and_texts_without_words(spark):
    assert variants(spark, []) == set()
    assert variants(spark, [(1, "ab cd", "x", 1), (2, None, "x", 1)]) == set()


def test_long_texts_are_cut_between_runs(monkeypatch):
    text = "abcde " * 50 + "é" * 100 + " fghij"
    whole = sv.runs(text)
    monkeypatch.setattr(sv, "PIECE", 7)
    assert sv.runs(text) == whole == Counter({"abcde": 50, "é" * 100: 1, "fghij": 1})


_WORD = st.text("abéz", min_size=5, max_size=5)


@given(st.lists(_WORD, min_size=1, max_size=12, unique=True), st.lists(st.text("abéz", min_size=5, max_size=6), max_size=12, unique=True))
def test_a_cell_finds_what_is_one_edit_away(home, guests):
    a, b = sv.near_in_cell(home, guests)
    assert sorted(zip(a.tolist(), b.tolist())) == [(i, j) for i, u in enumerate(home) for j, v in enumerate(guests) if near(u, v)]
