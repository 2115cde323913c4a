"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports what is matched.

Words are runs of letters and digits (and of any non-ASCII bytes), ASCII case folded. Templates are winnowed: of every
``WINDOW`` consecutive ``GRAM``-word hashes the smallest is kept, in an inverted index from hash to (template, position).
Whole documents are winnowed alike, so any common run of ``WINDOW + GRAM - 1`` words has a fingerprint in common. Hits of
a template whose shifts between document and template stay together make a candidate; it needs ``SHARE`` of the template's
own fingerprints. The longest chain of its hits that rises on both sides is laid: equal words count along the diagonals of
the hits, and the gaps between them, the head and the tail are aligned by dynamic programming inside a band of ``BAND``
words more than their lengths differ. Coverage is the share of the template's words that are aligned with equal words, the
span reaches from the first to the last of them. Words that tell a license from others (its name and version) must all
match, side by side: a license or version that has no template is not reported as its neighbour.

Templates are a bounded table (notices and whole licenses, not data), so the index travels with the task and nothing is shuffled.
Reported are candidates with a coverage of at least ``COVERAGE``; of overlapping ones of a document the one with most
matched words less the words that template and span have beside them. Nulls: a null text has no license; other columns are passed through; empty tables give empty results.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cobblestone.llm.common import map_batches
from cobblestone.llm.words import LOWER, Words, chunks, flat, sliding_argmin, split

GRAM, WINDOW, BAND = 3, 3, 8
COVERAGE = 0.8
#: Share of a template's fingerprints that a candidate has.
SHARE = 0.1
_DOT = ord(".")

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation'
    " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
    " permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright"
    " notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_WARRANTY = (
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE'
    " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR"
    " COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR"
    " OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
    " provided that the above copyright notice and this permission notice appear in all copies."
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL'
    " IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,"
    " INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN"
    " ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF"
    " THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
    " conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and"
    " the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of"
    " conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
    " derived from this software without specific prior written permission."
)
_BSD_WARRANTY = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,'
    " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
    " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
    " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;"
    " LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN"
    " CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS"
    " SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


_BSD_ADVERTISING = (
    " 3. All advertising materials mentioning features or use of this software must display the following acknowledgement:"
    " This product includes software developed by the organization. 4. Neither the name of the copyright holder nor the names of"
    " its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
)


def _gnu(what: str, name: str, version: str) -> dict[str, str]:
    """The grant alone (two wordings of the version) and the whole notice of a GNU license."""
    start = f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {{GNU {name}}} as published by the Free Software Foundation, "
    later = start + f"either {{version {version}}} of the License, or (at your option) any later version."
    rest = (
        f" This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty"
        f" of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a"
        f" copy of the GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."
    )
    return {"grant": later, "only-grant": start + f"{{version {version}}} of the License.", "header": later + rest}


def _templates() -> dict[str, str]:
    """Name -> text. A name is the license and the kind of text: ``notice`` and ``short`` (a sentence), ``grant``, ``header``
    (of a source file) or ``text`` (whole). Words in braces tell a license from others: they must match, side by side."""
    out = {
        "Apache-2.0-header": (
            'Licensed under the {Apache License, Version 2.0} (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
        ),
        "MIT-grant": _MIT_GRANT, "MIT-text": _MIT_GRANT + _MIT_WARRANTY, "ISC-text": _ISC,
        "BSD-2-Clause-text": _BSD_HEAD + _BSD_WARRANTY, "BSD-3-Clause-text": _BSD_HEAD + _BSD_NAMES + _BSD_WARRANTY,
        "BSD-4-Clause-text": _BSD_HEAD + _BSD_ADVERTISING + _BSD_WARRANTY,
        "MPL-2.0-header": (
            "This Source Code Form is subject to the terms of the {Mozilla Public License, v. 2.0}. If a copy of the MPL was not"
            " distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
        ),
        "Apache-2.0-notice": "Licensed under the {Apache License, Version 2.0}.",
        "MPL-2.0-notice": "Licensed under the {Mozilla Public License, version 2.0}.",
    }
    for name in ("MIT", "ISC", "BSD 2-Clause", "BSD 3-Clause", "BSD 4-Clause"):
        out[name.replace(" ", "-") + "-notice"] = f"Released under the {{{name} License}}."
    for short, name, versions in (
        ("GPL", "General Public License", ("2", "3")), ("LGPL", "Lesser General Public License", ("2.1", "3")),
        ("AGPL", "Affero General Public License", ("3",)),
    ):
        for version in versions:
            ident = f"{short}-{version if '.' in version else version + '.0'}"
            out[f"{ident}-notice"] = f"This work is licensed under the {{GNU {name}, version {version}}}."
            for what in ("program", "library") if short == "LGPL" else ("program",):
                for part, text in _gnu(what, name, version).items():
                    out[f"{ident}-{part}" + ("-library" if what == "library" else "")] = text
    for short, name in (
        ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    ):
        for version, where in (("4.0", "International"), ("3.0", "Unported")):
            ident = f"CC-{short}-{version}"
            out[f"{ident}-notice"] = f"This work is licensed under a {{Creative Commons {name} {version}}} {where} License."
            out[f"{ident}-short"] = f"Licensed under {{CC {short} {version}}}."
    for file in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        out[f"{file.stem}-text"] = file.read_text(encoding="utf-8")
    return out


def plain_text(template: str) -> str:
    """A template without the braces around its telling words."""
    return _TELLING.sub(r"\1", template)


_TELLING = re.compile(r"\{([^{}]*)\}")
TEMPLATES = _templates()

_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _words(column: pa.Array) -> Iterator[Words]:
    data, offsets = flat(column)
    for first, last in chunks(offsets):
        part = data[offsets[first] : offsets[last]]
        plain = np.where(_APART[part], np.uint8(0x20), LOWER[part])
        words = split(plain, offsets[first : last + 1] - offsets[first], first)
        words.raw = part  # the bytes as they are
        yield words


def winnow(words: Words, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of the fingerprints of the words ``lo .. hi``."""
    grams = words.spans(np.arange(lo, hi - GRAM + 1), np.arange(lo + GRAM, hi + 1)) if hi - lo >= GRAM else np.zeros(0, np.uint64)
    if not len(grams):
        return grams, np.zeros(0, np.int64)
    keep = np.unique(sliding_argmin(grams, min(WINDOW, len(grams)))[: max(1, len(grams) - WINDOW + 1)])
    return grams[keep], keep + lo


class Index:
    """Templates as word codes, the words that must match, and their fingerprints sorted by hash."""

    def __init__(self, templates: dict[str, str]):
        self.names, self.codes, self.telling, self.sizes = list(templates), [], [], []
        hashes, owners, places = [], [], []
        for owner, template in enumerate(templates.values()):
            marks, shift = [], 0
            for m in _TELLING.finditer(template):
                marks.append((len(template[: m.start()].encode()) - shift, len(template[: m.end()].encode()) - shift - 2))
                shift += 2
            words = next(_words(pa.array([plain_text(template)], pa.string())))
            n = len(words.begin)
            self.codes.append(words.codes())
            self.telling.append([np.flatnonzero((words.begin >= lo) & (words.end <= hi)) for lo, hi in marks])
            h, at = winnow(words, 0, n)
            hashes.append(h)
            owners.append(np.full(len(h), owner))
            places.append(at)
            self.sizes.append(len(h))
        hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.owners = np.concatenate(owners)[order] if owners else order
        self.places = np.concatenate(places)[order] if places else order

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into hashes, template, position) of equal fingerprints."""
        lo, hi = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        reps = hi - lo
        at = np.repeat(lo - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
        return np.repeat(np.arange(len(hashes)), reps), self.owners[at], self.places[at]


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int = BAND) -> list[tuple[int, int]]:
    """Pairs (template word, text word) of a longest common subsequence inside the band |text - template - shift| <= band."""
    n, width = len(template), 2 * band + 1
    best = np.zeros((n + 1, width + 2), np.int32)  # columns: diagonal + band + 1
    same = np.zeros((n, width), bool)
    diagonals = np.arange(-band, band + 1)
    for i in range(n):
        at = i + shift + diagonals
        ok = (at >= 0) & (at < len(text))
        same[i, ok] = text[at[ok]] == template[i]
        row = np.maximum(best[i, 1:-1] + same[i], best[i, 2:])
        best[i + 1, 1:-1] = np.maximum.accumulate(row)
    pairs, i, d = [], n, width
    while i > 0 and d > 0:
        if d > 1 and best[i, d] == best[i, d - 1]:
            d -= 1
        elif d <= width - 1 and best[i, d] == best[i - 1, d + 1]:
            i, d = i - 1, d + 1
        elif same[i - 1, d - 1] and best[i, d] == best[i - 1, d] + 1:
            pairs.append((i - 1, i - 1 + shift + int(diagonals[d - 1])))
            i -= 1
        else:
            i -= 1
    return pairs[::-1]


def _chain(place: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
    """The longest chain of hits that rise in the template and in the text."""
    order = np.lexsort((-at, place))
    ends, last, back, rows = [], [], [], list(zip(place[order].tolist(), at[order].tolist()))
    for i, (_, t) in enumerate(rows):
        k = bisect_left(ends, t)
        back.append(last[k - 1] if k else -1)
        ends[k : k + 1], last[k : k + 1] = [t], [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(rows[i])
        i = back[i]
    return out[::-1]


def _candidates(place: np.ndarray, at: np.ndarray, length: int, least: float) -> Iterator[list[tuple[int, int]]]:
    """Chains of hits of one template where most shifts stay together; what a chain spans is gone before the next one."""
    order = np.argsort(at - place, kind="stable")
    place, at = place[order], at[order]
    width = max(BAND // 2, length // 2)  # less than a copy further on
    while len(at) >= max(1, least):
        shift = at - place
        counts = np.searchsorted(shift, shift + width, "right") - np.arange(len(shift))
        first = int(counts.argmax())
        if counts[first] < least:
            return
        chain = _chain(place[first : first + counts[first]], at[first : first + counts[first]])
        yield chain
        left = (at < chain[0][1]) | (at > chain[-1][1])
        place, at = place[left], at[left]


def align_chain(template: np.ndarray, text: np.ndarray, chain: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs (template word, text word) along a chain of hits: equal words on the diagonals of the hits, banded alignment
    before, between and after them."""
    runs = []  # template first, end; shift
    for p, t in chain:
        if runs and runs[-1][2] == t - p:
            runs[-1][1] = p + GRAM
        else:
            runs.append([p, p + GRAM, t - p])
    p0, t0 = runs[0][0], runs[0][0] + runs[0][2]
    lo = max(0, t0 - p0 - BAND)
    pairs = [(p, t + lo) for p, t in align(template[:p0], text[lo:t0], t0 - lo - p0)] if p0 else []
    p_end, t_end = p0, t0
    for first, end, shift in runs:
        first = max(first, p_end, t_end - shift)
        if first >= end:
            continue
        gap, over = template[p_end:first], text[t_end : first + shift]
        if len(gap) and len(over):
            pairs += [(p + p_end, t + t_end) for p, t in align(gap, over, 0, BAND + abs(len(over) - len(gap)))]
        same = np.flatnonzero(template[first:end] == text[first + shift : end + shift]) + first
        pairs += zip(same.tolist(), (same + shift).tolist())
        p_end, t_end = end, end + shift
    tail = template[p_end:]
    if len(tail):
        pairs += [(p + p_end, t + t_end) for p, t in align(tail, text[t_end : t_end + len(tail) + BAND], 0)]
    return pairs


def _told(pairs: list[tuple[int, int]], telling: list[np.ndarray], words: Words, base: int) -> bool:
    """Are the words that tell the license apart all there, side by side, and no version cut short (2 of 2.1)?"""
    where = dict(pairs)
    for group in telling:
        found = [where.get(p) for p in group.tolist()]
        if None in found or any(b != a + 1 for a, b in zip(found, found[1:])):
            return False
        i = base + found[-1]
        stop = words.end[i]
        if i + 1 < len(words.begin) and words.begin[i + 1] == stop + 1 and words.raw[stop] == _DOT:
            if all(48 <= c < 58 for c in (words.data[words.begin[i]], words.data[words.begin[i + 1]])):
                return False
    return True


def _matches(words: Words, d: int, index: Index, hashes: np.ndarray, at: np.ndarray, coverage: float):
    lo, hi = int(words.bounds[d]), int(words.bounds[d + 1])
    which, owner, place = index.hits(hashes)
    at = at[which] - lo
    text, found = words.codes()[lo:hi], []
    for name in np.unique(owner).tolist():
        template, own = index.codes[name], owner == name
        for chain in _candidates(place[own], at[own], len(template), SHARE * index.sizes[name]):
            pairs = align_chain(template, text, chain)
            if pairs and len(pairs) >= coverage * len(template) and _told(pairs, index.telling[name], words, lo):
                found.append((len(pairs), len(pairs) / len(template), name, pairs[0][1], pairs[-1][1] + 1))
    taken: list[tuple[int, int]] = []
    # matched words less those left out on either side, so that of close variants the true one comes first
    missed = {f: len(index.codes[f[2]]) + f[4] - f[3] - 2 * f[0] for f in found}
    for matched, share, name, first, last in sorted(found, key=lambda f: (missed[f] - f[0], f[3], f[2])):
        if all(last <= a or first >= b for a, b in taken):
            taken.append((first, last))
            yield name, share, matched, first, last


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without its text, a row per license found: license, coverage, matched_words, first_word, last_word
    (excluded), first_byte and last_byte of the span in UTF-8."""
    names = ["license", "coverage", "matched_words", "first_word", "last_word", "first_byte", "last_byte"]
    rest = [f for f in docs.schema.fields if f.name not in (text, *names)]
    index = Index(TEMPLATES if templates is None else templates)
    wanted = np.unique(index.hashes)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for words in _words(batch.column(0)):
            n, out, rows = len(words.begin), [], []
            if n < GRAM or not len(wanted):
                continue
            at = words.windows(GRAM)
            grams = words.spans(at, at + GRAM)
            # every fingerprint of a template that a text shares is among these; winnowing the text thins them alike
            owners = words.owner[at[np.isin(grams, wanted)]]
            for d in np.unique(owners).tolist():
                hashes, places = winnow(words, int(words.bounds[d]), int(words.bounds[d + 1]))
                for name, share, matched, first, last in _matches(words, d, index, hashes, places, coverage):
                    base = int(words.bounds[d])
                    out.append((index.names[name], share, matched, first, last,
                                int(words.begin[base + first] - words.offsets[d]), int(words.end[base + last - 1] - words.offsets[d])))
                    rows.append(words.first + d)
            if rows:
                part = batch.take(pa.array(rows))
                kinds = [pa.string(), pa.float64()] + [pa.int64()] * 5
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], [f.name for f in rest] + names)

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest)
    schema += "license string, coverage double, matched_words bigint, first_word bigint, last_word bigint, first_byte bigint, last_byte bigint"
    return map_batches(docs.select(F.col(text).alias("_text"), *(F.col(f"`{f.name}`") for f in rest)), run, schema)
