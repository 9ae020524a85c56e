"""License notices in documents, by patience alignment with templates.

Words that occur once in a part of the text and once in the template are
anchors.  The longest increasing subsequence of their places is kept, and the
gaps between are aligned in the same way.  The share of the template's words that
are aligned is its coverage.
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from heapq import heappop, heappush
from pathlib import Path

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Least share of a template's words that are found in order.
COVERAGE = 0.8
#: A notice may be longer than its template by this share of it and two words.
SLACK = 0.25

#: Whole license texts, and notices of their own wording; read where the job is planned, not by its tasks.
TEXTS = Path(__file__).parent / "license_texts"

# Words that tell a full text from others ("-": a word that must not stand in the aligned stretch).
FULL = {
    "apache-2.0": "perpetual irrevocable contributor", "artistic-1.0": "artistic semblance", "cc0-1.0": "affirmer waiver",
    "gfdl-1.2": "invariant cover 1.2", "gfdl-1.3": "invariant cover multiauthor",
    "gpl-1.0": "general nominal mercy", "gpl-2.0": "general 1991", "gpl-3.0": "convey propagate -cooperation",
    "lgpl-2.0": "library 1991 linked -lesser", "lgpl-2.1": "lesser linked", "lgpl-3.0": "lesser combined minimal",
    "mpl-1.1": "covered initial developer", "mpl-2.0": "covered incompatible secondary",
}

# SPDX identifier, words that tell the names (see above), names of a license.
NAMES = (
    ("MIT", "mit", ("MIT License", "MIT license terms")),
    ("Apache-2.0", "apache", ("Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache Software License 2.0")),
    ("GPL-1.0", "gnu general 1 -lesser -library -affero", ("GNU General Public License, version 1",)),
    ("GPL-2.0", "gnu general -lesser -library -affero", ("GNU General Public License, version 2", "GNU General Public License, version 2.0", "GNU General Public License v2", "GNU General Public License v2.0")),
    ("GPL-2.0", "", ("GPLv2", "GPL-2.0", "GPL version 2", "GPL v2", "GPL 2.0")),
    ("GPL-3.0", "gnu general -lesser -library -affero", ("GNU General Public License, version 3", "GNU General Public License, version 3.0", "GNU General Public License v3", "GNU General Public License v3.0")),
    ("GPL-3.0", "", ("GPLv3", "GPL-3.0", "GPL version 3", "GPL v3", "GPL 3.0")),
    ("LGPL-2.0", "gnu library", ("GNU Library General Public License, version 2",)),
    ("LGPL-2.1", "gnu lesser", ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1")),
    ("LGPL-2.1", "", ("LGPLv2.1", "LGPL-2.1", "LGPL version 2.1", "LGPL v2.1", "LGPL 2.1")),
    ("LGPL-3.0", "gnu lesser", ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3", "GNU Lesser General Public License v3.0")),
    ("LGPL-3.0", "", ("LGPLv3", "LGPL-3.0", "LGPL version 3", "LGPL v3", "LGPL 3.0")),
    ("AGPL-3.0", "gnu affero", ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3", "GNU Affero General Public License v3.0")),
    ("AGPL-3.0", "", ("AGPLv3", "AGPL-3.0", "AGPL version 3", "AGPL v3", "AGPL 3.0")),
    ("BSD-2-Clause", "bsd", ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause License", "FreeBSD License")),
    ("BSD-3-Clause", "bsd", ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License", "BSD-3-Clause License")),
    ("BSD-4-Clause", "bsd", ("BSD 4-Clause License", "4-Clause BSD License", "Original BSD License", "BSD-4-Clause License")),
    ("0BSD", "", ("Zero-Clause BSD License", "0BSD License")),
    ("ISC", "isc", ("ISC License",)),
    ("MPL-1.1", "", ("Mozilla Public License, version 1.1", "Mozilla Public License 1.1", "MPL 1.1", "MPL-1.1")),
    ("MPL-2.0", "", ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License v2.0", "MPL 2.0", "MPL-2.0")),
    ("EPL-1.0", "", ("Eclipse Public License 1.0", "Eclipse Public License v1.0", "EPL-1.0", "EPL 1.0")),
    ("EPL-2.0", "", ("Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License v. 2.0", "EPL-2.0", "EPL 2.0")),
    ("CDDL-1.0", "", ("Common Development and Distribution License 1.0", "CDDL 1.0", "CDDL-1.0")),
    ("EUPL-1.2", "", ("European Union Public Licence 1.2", "EUPL 1.2", "EUPL-1.2", "EUPL v1.2")),
    ("CC0-1.0", "", ("CC0 1.0", "CC0-1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "Creative Commons CC0 License", "CC0")),
    ("Unlicense", "unlicense", ("Unlicense",)),
    ("Zlib", "zlib", ("zlib License",)),
    ("BSL-1.0", "boost", ("Boost Software License, Version 1.0", "Boost Software License 1.0")),
    ("WTFPL", "", ("WTFPL",)),
    ("Artistic-2.0", "", ("Artistic License 2.0", "Artistic License, Version 2.0")),
    ("Python-2.0", "", ("Python Software Foundation License", "PSF License")),
    ("GFDL-1.2", "gnu documentation", ("GNU Free Documentation License, Version 1.2",)),
    ("GFDL-1.3", "gnu documentation", ("GNU Free Documentation License, Version 1.3",)),
    ("OFL-1.1", "", ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1")),
    ("ODbL-1.0", "", ("Open Database License 1.0", "Open Database License v1.0", "ODbL 1.0", "ODbL v1.0")),
    ("ODC-By-1.0", "", ("Open Data Commons Attribution License v1.0", "ODC-By 1.0", "ODC-By v1.0")),
)
COMMONS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
#: Words of names that may be missing; all others tell the name.
_FILLING = frozenset("license licence the public version v international unported universal software terms and".split())


def _notices() -> Iterator[tuple[str, str, str]]:
    """Name (an SPDX identifier, with ``-header`` or ``-text`` behind it for the long wordings), words that tell it, wording."""
    for spdx, needs, phrases in (*NAMES, *_commons()):
        name = spdx.lower()
        for phrase in phrases:
            bars = [w for w in needs.split() if w.startswith("-")]
            own = " ".join([*dict.fromkeys([*(w for w in words_of(phrase) if w and w not in _FILLING), *(w for w in needs.split() if w in words_of(phrase))]), *bars])
            yield name, own, f"Licensed under the {phrase}."
            yield name, f"under {own}", f"under {phrase}"
            yield name, f"under {own}", f"under the {phrase}"
        for end in ("", "-only", "-or-later", "+") if "GPL" in spdx else ("",):
            yield name, f"{name}{end} spdx-license-identifier", f"SPDX-License-Identifier: {spdx}{end}"
            if "-" in spdx:
                yield name, f"{name}{end} license", f"License: {spdx}{end}"
    for spdx, needs in FULL.items():
        yield f"{spdx}-text", needs, (TEXTS / f"{spdx}.txt").read_text("utf-8")
    for part in (TEXTS / "notices.txt").read_text("utf-8").split("== ")[1:]:
        head, text = part.split("\n", 1)
        name, needs = head.split(" ", 1)
        yield name, needs, text
    yield "apache-2.0", "apache 2.0", "Licensed under the Apache License, Version 2.0."
    yield "mit", "mit", "Released under the MIT License."
    yield "cc-by-nc-4.0", "by-nc 4.0", "Licensed under CC BY-NC 4.0."
    yield "gpl-3.0", "gnu general 3 -lesser -library -affero", "This work is licensed under the GNU General Public License, version 3."
    yield (
        "apache-2.0-header", "apache except compliance",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at",
    )
    yield (
        "mit-text", "permission granted free charge",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    )


def _commons() -> Iterator[tuple[str, str, tuple[str, ...]]]:
    """The Creative Commons licenses in their versions."""
    for code, long in COMMONS.items():
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            loose = long.replace("NonCommercial", "Non-Commercial"), long.replace("NoDerivatives", "NoDerivs"), long.replace("ShareAlike", "Share Alike")
            names = [f"Creative Commons {n} {version}" for n in dict.fromkeys([long, *loose])]
            names += [f"Creative Commons {long} {version} {kind} License" for kind in ("International", "Unported", "International Public")]
            names += [f"CC {code} {version}", f"CC-{code} {version}", f"CC-{code}-{version}"]
            yield f"CC-{code}-{version}", "", tuple(names)


def words_of(text: str) -> list[str]:
    """Lower-cased words at ASCII white space, without punctuation around them."""
    return [w.strip(b".,;:!?()[]{}\"'*").decode("utf-8", "replace") for w in text.encode("utf-8", "surrogatepass").lower().split()]


def _links() -> Iterator[tuple[str, str, str]]:
    """Links to the Creative Commons licenses, each one word."""
    for code in COMMONS:
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            for start in ("http://", "https://", "http://www.", "https://www."):
                for end in ("", "/", "/deed.en", "/legalcode"):
                    link = f"{start}creativecommons.org/licenses/{code.lower()}/{version}{end}"
                    yield f"cc-{code.lower()}-{version}", link, link
    for start in ("http://", "https://"):
        for end in ("", "/"):
            link = f"{start}creativecommons.org/publicdomain/zero/1.0{end}"
            yield "cc0-1.0", link, link


NOTICES = tuple(dict.fromkeys([*_links(), *_notices()]))


def align(text: Sequence[str], template: Sequence[str]) -> list[tuple[int, int]]:
    """Aligned places (text, template) in increasing order."""
    found, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        in_text, in_template = Counter(text[a:b]), Counter(template[c:d])
        once = {w: i for i, w in enumerate(text[a:b], a) if in_text[w] == 1 and in_template[w] == 1}
        anchors = [(once[w], j) for j, w in enumerate(template[c:d], c) if w in once]
        chain = _longest_increasing(anchors)
        found += chain
        edges = [(a - 1, c - 1), *chain, (b, d)]
        if chain:
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if i + 1 < k and j + 1 < m]
    return sorted(found)


def _longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of ``pairs`` (in order of their second member) whose first members increase."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, (i, _) in enumerate(pairs):
        at = bisect_left(tails, i)
        before.append(ends[at - 1] if at else -1)
        tails[at:at + 1] = [i]
        ends[at:at + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


#: Coverage, matched words, first and last place (excluded) in the text.
Hit = tuple[float, int, int, int]


@dataclass(frozen=True)
class Notice:
    name: str
    needs: frozenset[str]
    bars: frozenset[str]  # words that must not stand in the aligned stretch
    words: tuple[str, ...]

    @classmethod
    def of(cls, name: str, needs: str, text: str) -> Notice:
        marks = needs.split()
        bars = frozenset(w[1:] for w in marks if w.startswith("-"))
        return cls(name, frozenset(w for w in marks if not w.startswith("-")), bars, tuple(words_of(text)))

    def least(self, coverage: float) -> int:
        """Words that have to be aligned."""
        return max(1, int(-(-coverage * len(self.words) // 1)))

    def find(self, words: Sequence[str], places: dict[str, list[int]], coverage: float) -> list[Hit]:
        """Places of the notice that do not overlap, the one of most aligned words (then the shortest) first; none below
        ``coverage``.

        Of the words that are fewest in the text, more than may be missing are looked up, so that every possible place of
        the notice is looked at; a place is the stretch around such a word.  Stretches of long notices that begin and end
        within an eighth of the slack are looked at as one.  Each is looked at with and without the slack, and what is left
        of it beside a place that is taken once more: words of a neighbouring copy are no anchors, as they stand twice.
        """
        n, least = len(self.words), self.least(coverage)
        slack = int(n * SLACK) + 2
        rare = sorted(range(n), key=lambda j: (len(places.get(self.words[j], ())), j))[: n - least + 1]
        grid = max(1, slack // 8)
        diagonals = {(i - j) // grid * grid for j in rare for i in places.get(self.words[j], ())}
        spots = sorted({(max(0, d - more), min(len(words), d + grid - 1 + n + more)) for d in diagonals for more in (0, slack)})
        found: list[tuple[int, int, int, int]] = []
        looked: set[tuple[int, int]] = set()

        def look(lo: int, hi: int) -> None:
            if hi - lo < least or (lo, hi) in looked:
                return
            looked.add((lo, hi))
            pairs = align(words[lo:hi], self.words)
            if len(pairs) >= least and self.needs <= {self.words[j] for _, j in pairs} and self.bars.isdisjoint(words[lo + pairs[0][0] : lo + pairs[-1][0] + 1]):
                start, end = lo + pairs[0][0], lo + pairs[-1][0] + 1
                heappush(found, (-len(pairs), end - start, start, end))

        for spot in spots:
            look(*spot)
        widest = grid - 1 + n + 2 * slack
        taken: list[tuple[int, int]] = []
        hits: list[Hit] = []
        while found:
            matched, _, start, end = heappop(found)
            if not _take(taken, start, end):
                continue
            hits.append((-matched / n, -matched, start, end))
            at = bisect_left(taken, (start, end))
            left = taken[at - 1][1] if at else 0
            right = taken[at + 1][0] if at + 1 < len(taken) else len(words)
            for lo, hi in spots[bisect_left(spots, (start - widest, 0)) : bisect_left(spots, (end, 0))]:
                if hi > start:
                    look(max(lo, left), min(hi, start))
                    look(max(lo, end), min(hi, right))
        return hits


def _take(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Add a stretch to those in order, unless it overlaps one."""
    at = bisect_left(taken, (start, end))
    if (at and taken[at - 1][1] > start) or (at < len(taken) and taken[at][0] < end):
        return False
    taken.insert(at, (start, end))
    return True


def by_word(notices: Sequence[Notice]) -> dict[str, list[Notice]]:
    """Notices by the one of their needed words that is likely the rarest."""
    out: dict[str, list[Notice]] = {}
    for n in notices:
        words = n.needs or n.words[:1]
        out.setdefault(max(words, key=lambda w: (w not in ("under", "license", "general"), len(w), w)), []).append(n)
    return out


def find_notices(
    text: str | None, notices: Mapping[str, Sequence[Notice]], coverage: float = COVERAGE, every_place: bool = False
) -> list[tuple[str, float, int, int, int]]:
    """``(name, coverage, matched, start, end)`` of every notice in a text, in words: of all wordings of a name the best
    place, or with ``every_place`` all that do not overlap a better one, in their order."""
    words = words_of(text or "")
    places: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    hits: dict[str, list[Hit]] = {}
    # A needed word that the text does not have cannot be aligned.
    for n in (n for w in sorted(notices.keys() & places.keys()) for n in notices[w]):
        if all(w in places for w in n.needs):
            hits.setdefault(n.name, []).extend(n.find(words, places, coverage))
    out = []
    for name, of_name in hits.items():
        taken: list[tuple[int, int]] = []
        best = sorted(of_name, key=lambda h: (-h[0], -h[1], h[3] - h[2], h[2]))
        kept = [h for h in best if _take(taken, h[2], h[3])] if every_place else best[:1]
        out += [(name, *h) for h in kept]
    return sorted(out, key=lambda h: h[3:]) if every_place else out


def scan_licenses(
    docs: DataFrame, notices: Sequence[tuple[str, str, str]] = NOTICES, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text",
    every_place: bool = False,
) -> DataFrame:
    """One row for every notice that a row of ``docs`` holds: the id, ``license``, ``coverage``, ``matched``,
    ``start_word``, ``end_word`` (excluded); one row with nulls for a row of ``docs`` without any.

    The best place of each ``license`` in any of its wordings is given, the first of equal ones; with ``every_place`` every
    place that does not overlap a better one of the same license.  Null and blank texts hold none; repeated rows are
    repeated.  Texts are read whole, of any length: places are looked up by rare words, so time grows with the words and
    the places.  Narrow: no shuffle, and memory for a batch of texts.
    """
    templates = by_word([Notice.of(*n) for n in notices])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                hits = find_notices(text, templates, coverage, every_place) or [(None,) * 5]
                at += [i] * len(hits)
                rows += hits
            kinds = (pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            found = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *found], ["id", "license", "coverage", "matched", "start_word", "end_word"]
            )

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    kind = read.schema["id"].dataType.simpleString()
    found = read.mapInArrow(run, f"id {kind}, license string, coverage double, matched int, start_word int, end_word int")
    return found.withColumnRenamed("id", id_col)
