"""Token alignment against a plain version that encodes with the reference tokenizers and counts links in a dict."""

import hashlib
import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from cobblestone.llm import token_alignment as ta
from cobblestone.llm.common import table

pytestmark = pytest.mark.skipif(not os.path.isdir(ta.FOLDER), reason="no tokenizer files here")
SF = "/root/testdata/sf0.001"
FIELDS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

TEXTS = [
    None, "", " ", "a", "The cat  sat\n\non the mat.", "naïve café — 東京 🙂", "<|endoftext|> </s> <unk> <s>", "x" * 5000, "\n" * 6000 + "a",
    "▁ sign", "é combining", "tab\tand\x00nul", "The cat  sat\n\non the mat.", "the the the the the", " leading and trailing  ", "ﬁ ligature",
]


def reference(texts):
    """Rows without doc_id, in the order of ``texts``."""
    with_ = ta.encoders(ta.FOLDER)
    docs, links = [], Counter()
    for text in texts:
        raw = b" " + (text or "").encode()
        a = with_.reference.encode(" " + text, add_special_tokens=False).ids if text else []
        b = with_.pieces.encode(text) if text else []
        ends = []
        for ids, names in ((a, with_.bytes_a), (b, with_.bytes_b)):
            at, out = 0, []
            for i in ids:
                at += len(names[i])
                out.append(at)
            ends.append(out)
        if b"".join(with_.bytes_a[i] for i in a) != raw or b"".join(with_.bytes_b[i] for i in b) != raw:
            a, b, ends = [], [], [[], []]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, last = [], 0
        for cut in cuts:
            groups.append([[i for i, e in zip(ids, end) if last < e <= cut] for ids, end in zip((a, b), ends)])
            last = cut
        own = [(x, y) for x, ex in zip(a, ends[0]) for y, ey in zip(b, ends[1]) if ex == ey] if len(a) < 3000 else [(x[-1], y[-1]) for x, y in groups]
        links.update(own)
        docs.append((a, b, groups, own))
    top = defaultdict(int)
    for (_, y), n in links.items():
        top[y] = max(top[y], n)
    rows = []
    for a, b, groups, own in docs:
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(a), len(b), len(groups), len(own), sum(links[p] == top[p[1]] for p in own), sum(links[p] for p in own),
                     hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return rows


@pytest.mark.parametrize("block, links", [(4096, 2 << 20), (3, 40)])
def test_equal_to_plain_version(spark, block, links, monkeypatch):
    monkeypatch.setattr(ta, "LINKS", links)
    rows = [(None if i == 3 else i // 2, t, 1, "x") for i, t in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, block int, a string").coalesce(1 if block > 3 else 4)
    got = [tuple(r) for r in ta.alignment(df).select(*FIELDS).collect()]
    want = [(r[0], *x) for r, x in zip(rows, reference([r[1] for r in rows]))]
    order = lambda x: tuple((v is None, v) for v in x)
    assert sorted(got, key=order) == sorted(want, key=order)
    assert sum(x[4] > 0 for x in got) > 20 and {0} < {x[1] for x in got}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_equal_on_documents(spark):
    docs = table(spark, SF, "documents")
    rows = docs.select("doc_id", "text").collect()
    want = {(r[0], *x) for r, x in zip(rows, reference([r[1] for r in rows]))}
    assert {tuple(r) for r in ta.alignment(docs).select(*FIELDS).collect()} == want


def test_empty_table(spark):
    assert ta.alignment(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_fast_encoder_equals_the_reference(text):
    with_ = ta.encoders(ta.FOLDER)
    assert with_.encode_a(" " + text) == with_.reference.encode(" " + text, add_special_tokens=False).ids


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 700)), min_size=1, max_size=60), st.integers(1, 300))
def test_planes_keep_every_document_and_link(pairs, repeat):
    """Sparse and dense planes read back what was written."""
    pairs = pairs + [(5, i) for i in range(repeat)] * 2 + [(6, 9)] * 5
    pair, slot = np.array(pairs, np.int64).T
    found, n_docs, n_links, planes = ta.postings(pair, slot)
    row, bit, member = ta.members(planes)
    back = Counter()
    for r, j, s in zip(row.tolist(), bit.tolist(), member.tolist()):
        back[int(found[r]), s] += 1 << j
    want = Counter(pairs)
    assert back == want
    for k, (p, d, n) in enumerate(zip(found.tolist(), n_docs.tolist(), n_links.tolist())):
        assert d == sum(q == p for q, _ in want) and n == sum(m for (q, _), m in want.items() if q == p)
