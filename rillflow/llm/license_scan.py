"""License scans by conditional compression.

Around each cue of a candidate block, every license template of which enough words are there is confirmed or rejected by
an exact word diff. Words are compressed alone and, with the template as zstandard raw dictionary, once more: the size
reduction decides between templates that differ by equally many words, and picks what an unknown block is compared with.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean

#: Notices, and the first sentences of licenses (OPENINGS), as their licenses word them.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "proprietary": "All rights reserved.",
}
#: Templates that only open a license: a whole match of one is no whole license.
OPENINGS = {"MIT-text", "BSD", "ISC", "Unlicense"}
#: Whole licenses, without what varies (copyright lines) and without the appendix after the terms.
TEXTS = {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}
#: So many paragraphs in a row that are in no whole license may stand between paragraphs of one.
GAP = 5
#: A line with one of these starts a candidate block. Every template and whole license here has one; of templates that a
#: variant may strip of all of them the scan looks for pairs of neighbouring words too (``wider_cues``).
CUES = r"(?i)licen[sc]e|permission (?:is hereby granted|to use)|redistribution and use|public domain|all rights reserved|free software|released (?:into|under)|under cc|\bcc0\b|\bgnu\b"
MAX_DIFFERENCE = 0.25
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def cues_of(templates: dict[str, str], max_difference: float = MAX_DIFFERENCE) -> str:
    """A regular expression that finds something in every text with one of ``templates`` within ``max_difference``.

    A differing word breaks at most two pairs of neighbours. So of a template that may differ in d words it takes the
    2 d + 1 longest pairs, one of which must be left, or the d + 1 longest words where it has fewer pairs.
    """
    found = set()
    for text in templates.values():
        w = words(text)
        allowed = int(max_difference * len(w))
        pairs = list(zip(w, w[1:], strict=False))
        if len(pairs) > 2 * allowed:
            found |= {r"[^a-z0-9]+".join(map(re.escape, p)) for p in sorted(pairs, key=lambda p: (-len(p[0] + p[1]), p))[: 2 * allowed + 1]}
        else:
            found |= {re.escape(x) for x in sorted(w, key=lambda x: (-len(x), x))[: allowed + 1]}
    by_first: dict = {}
    for x in sorted(found, key=lambda x: (-len(x), x)):
        by_first.setdefault(x[0], []).append(x[1:])
    return r"(?i)(?<![a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by_first.items())) + ")" if found else r"(?!)"


def wider_cues(templates: dict[str, str], cues: str = CUES, max_difference: float = MAX_DIFFERENCE) -> str | None:
    """``cues_of`` those templates that a variant within ``max_difference`` may strip of all ``cues``; None if there are none.

    A differing word breaks one at most of the cues that have no word in common.
    """
    lost = {}
    for name, text in templates.items():
        seen: set = set()
        disjoint = 0
        for m in re.finditer(cues, text):
            own = {w.start() for w in _WORD.finditer(text.lower()) if w.start() < m.end() and m.start() < w.end()}
            if not own & seen:
                disjoint, seen = disjoint + 1, seen | own
        if disjoint <= int(max_difference * len(words(text))):
            lost[name] = text
    return cues_of(lost, max_difference) if lost else None


@cache
def _templates(items: tuple[tuple[str, str], ...]):
    import zstandard

    out = []
    for name, text in items:
        data = zstandard.ZstdCompressionDict(" ".join(words(text)).encode() + b"\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append((name, words(text), zstandard.ZstdCompressor(level=19, dict_data=data, write_content_size=False)))
    plain = zstandard.ZstdCompressor(level=19, write_content_size=False)
    known = {w for _, text, _ in out for w in text if len(w) > 2} - {"and", "the", "this", "that", "any", "for", "all", "not", "was", "with", "you", "one", "may"}
    return out, plain, known


def _triples(w: list[str]) -> list[tuple[str, str, str]]:
    return list(zip(w, w[1:], w[2:], strict=False))


@cache
def _texts(items: tuple[tuple[str, str], ...]):
    import zstandard

    out = []
    for name, text in items:
        w = words(text)
        data = zstandard.ZstdCompressionDict(" ".join(w).encode() + b"\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append((name, w, Counter(w), zstandard.ZstdCompressor(level=19, dict_data=data, write_content_size=False)))
    return out, {t for _, w, _, _ in out for t in _triples(w)}


def extended(lines: list[str], start: int, first: int, after: int, triples: set) -> tuple[int, int]:
    """A block's lines with the paragraphs before (not before line ``start``) and after it of which a third at least of
    the word triples are in whole licenses, and what stands between them."""

    def reach(at: int, stop: int, step: int) -> int:
        end, gap = at, 0
        while gap <= GAP:
            while at != stop and not lines[min(at, at + step)].strip():
                at += step
            if at == stop:
                break
            begin = at
            while at != stop and lines[min(at, at + step)].strip():
                at += step
            own = _triples(words("\n".join(lines[min(begin, at) : max(begin, at)])))
            if own and 3 * sum(t in triples for t in own) >= len(own):
                end, gap = at, 0
            else:
                gap += 1
        return end

    return reach(first, start, -1), reach(after, len(lines), 1)


def either(cues: str, wider: str | None) -> str:
    """One expression for both; each starts with (?i)."""
    return f"{cues}|{wider.removeprefix('(?i)')}" if wider else cues


def candidate_blocks(text: str, known: set[str], triples: set = frozenset(), cues: str = CUES, wider: str | None = None) -> Iterator[tuple[int, int, str]]:
    """(first line, line after the last, block), in order: a cue's line with the lines around it of license words, a third
    at least, and the paragraphs around these that are of whole licenses. Then, in lines that are in none of these blocks,
    the same around ``wider`` cues."""
    if not re.search(either(cues, wider), text):
        return
    lines = text.split("\n")
    starts = list(accumulate((len(line) + 1 for line in lines), initial=0))

    def lines_with(pattern: str) -> list[bool]:
        found = [False] * len(lines)
        for m in re.finditer(pattern, text):  # a cue of several words may run over a line's end
            for i in range(bisect_right(starts, m.start()) - 1, bisect_right(starts, max(m.start(), m.end() - 1))):
                found[i] = True
        return found

    cued = lines_with(cues)

    def alike(line: str) -> bool:
        w = words(line)
        return bool(w) and 3 * sum(x in known for x in w) >= len(w)

    def around(seeds: list[bool], start: int, stop: int, low: int) -> Iterator[tuple[int, int]]:
        i = start
        while i < stop:
            if not seeds[i]:
                i += 1
                continue
            first, after = i, i + 1
            while first > low and alike(lines[first - 1]) and not cued[first - 1]:
                first -= 1
            while after < stop and alike(lines[after]) and not (cued[after] and lines[after - 1].rstrip().endswith(".")):
                after += 1
            if triples:
                first, after = extended(lines[:stop], start, first, after, triples)
            yield first, after
            i = start = after

    blocks = list(around(cued, 0, len(lines), 0))
    if wider:
        seeds, at, free = lines_with(wider), 0, []
        for first, after in [*blocks, (len(lines), len(lines))]:
            free += around(seeds, at, first, at)
            at = max(at, after)
        blocks = sorted(blocks + free)
    for first, after in blocks:
        yield first, after, "\n".join(lines[first:after])


def rank(block: str, items: tuple[tuple[str, str], ...]) -> list[tuple[float, str, int, int]]:
    """(relative size reduction, license, size alone, size given the template), best first."""
    templates, plain, _ = _templates(items)
    data = " ".join(words(block)).encode() + b"\n"
    alone = len(plain.compress(data))
    found = [((alone - (size := len(packer.compress(data)))) / alone, name, alone, size) for name, _, packer in templates]
    return sorted(found, key=lambda x: (-x[0], x[1]))


def align(block: list[str], template: list[str]) -> tuple[list[str], list[str], int, int]:
    """The template's words that the block lacks, the block's words between the matches beyond them, and the matches' span.

    Matches at either end that cost more words between them and the others than they have count as missing.
    """
    runs = [m for m in difflib.SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    if not runs:
        return template, block, 0, len(block)
    best = (0, 0, 0)
    value = start = 0
    for i, m in enumerate(runs):
        gap = m.b - runs[i - 1].b - runs[i - 1].size if i else 0
        value, start = (value - gap, start) if i and value > gap else (0, i)
        value += m.size
        best = max(best, (value, -start, i))
    runs = runs[-best[1] : best[2] + 1]
    lo, hi = runs[0].b, runs[-1].b + runs[-1].size
    met = {m.a + i for m in runs for i in range(m.size)}, {m.b + i for m in runs for i in range(m.size)}
    return [w for i, w in enumerate(template) if i not in met[0]], [block[i] for i in range(lo, hi) if i not in met[1]], lo, hi


def differences(block: list[str], template: list[str]) -> tuple[list[str], list[str]]:
    """The template's words that the block lacks, and the block's words between its first and last match beyond them."""
    return align(block, template)[:2]


def cue_places(block: str, cues: str = CUES) -> list[int]:
    """The number of the word that each cue of a block is in."""
    starts = [m.start() for m in _WORD.finditer(block.lower())]
    return sorted({max(0, bisect_right(starts, m.start()) - 1) for m in re.finditer(cues, block)})


def confirmed(own: list[str], places: list[int], items: tuple[tuple[str, str], ...], max_difference: float, top: int | None = None) -> list[tuple]:
    """(differing words, -reduction, name, size alone, size given, missing, added, span) of each template within
    ``max_difference`` that stands in the words ``own`` around one of ``places``; of overlapping ones the best, in order.

    The words around a place are compressed with each template of which enough words are there, the templates ranked by
    size reduction, and confirmed by their differences in that order: all of them, or the first ``top``. A template is
    left out before only where more of its words are absent around the cue than may differ.
    """
    templates, plain, _ = _templates(items)
    have: dict = {}
    alone_of: dict = {}
    by_window: dict = {}
    for name, template, packer in templates:
        allowed, wanted = int(max_difference * len(template)), Counter(template)
        reach = len(template) + allowed
        for lo, hi in sorted({(max(0, p - reach), min(len(own), p + reach + 1)) for p in places}):
            if (lo, hi) not in have:
                have[lo, hi] = Counter(own[lo:hi])
            if sum(max(0, n - have[lo, hi][w]) for w, n in wanted.items()) <= allowed:
                by_window.setdefault((lo, hi), []).append((name, template, packer, allowed))
    ranked = []
    for (lo, hi), near in by_window.items():
        data = " ".join(own[lo:hi]).encode() + b"\n"
        alone_of[lo, hi] = len(plain.compress(data))
        ranked += [((alone_of[lo, hi] - len(packer.compress(data))) / alone_of[lo, hi], name, lo, hi, template, packer, allowed) for name, template, packer, allowed in near]
    found = []
    for _, name, lo, hi, template, packer, allowed in sorted(ranked, key=lambda r: (-r[0], *r[1:4]))[:top]:
        missing, added, first, after = align(own[lo:hi], template)
        n = len(missing) + len(added)
        if n <= allowed:
            data = " ".join(own[lo + first : lo + after]).encode() + b"\n"
            alone, given = len(plain.compress(data)), len(packer.compress(data))
            found.append((n, (given - alone) / alone, name, alone, given, missing, added, lo + first, lo + after))
    out = []
    for f in sorted(found, key=lambda f: (f[0], f[7] - f[8], f[1], f[2])):
        if all(f[8] <= o[7] or f[7] >= o[8] for o in out):
            out.append(f)
    return sorted(out, key=lambda f: f[7])


def _shift(own: list[str], text: list[str]) -> int | None:
    """How many words of ``own`` stand before the part that has most of the text's word triples in their places, about."""
    at: dict = {}
    for i, t in enumerate(_triples(text)):
        at.setdefault(t, []).append(i)
    width = max(1, len(text) // 8)
    votes: Counter = Counter()
    for j, t in enumerate(_triples(own)):
        for b in {(j - i) // width for i in at.get(t, ())}:
            votes[b] += 1
    best = max(votes, key=lambda b: (votes[b] + max(votes[b - 1], votes[b + 1]), -b), default=None)
    return None if best is None else best * width


def _variant(own: list[str], texts: tuple[tuple[str, str], ...], max_difference: float) -> tuple | None:
    """(differing words, name, missing, added, span) of the whole license that differs least from words of ``own``."""
    have, best = Counter(own), None
    for name, text, wanted, _ in _texts(texts)[0]:
        allowed = int(max_difference * len(text))
        if sum(max(0, n - have[w]) for w, n in wanted.items()) > allowed:
            continue
        shift = _shift(own, text)
        if shift is None:
            continue
        at = max(0, shift - allowed)
        missing, added, first, after = align(own[at : max(at, shift + len(text) + allowed)], text)
        n = len(missing) + len(added)
        if n <= allowed and (best is None or n < best[0]):
            best = n, name, missing, added, at + first, at + after
    return best


def whole(own: list[str], texts: tuple[tuple[str, str], ...], max_difference: float) -> list[tuple]:
    """Like ``confirmed``'s, of the whole licenses in the words of a block: first the exact ones, then variants between."""
    if not texts or not own:
        return []
    spans, joined = [], f" {' '.join(own)} "
    starts = [m.start() for m in re.finditer(" ", joined)]
    for name, text, _, _ in sorted(_texts(texts)[0], key=lambda t: -len(t[1])):
        sought, at = f" {' '.join(text)} ", -1
        while (at := joined.find(sought, at + 1)) >= 0:
            first = bisect_right(starts, at) - 1
            if all(first + len(text) <= s[4] or first >= s[5] for s in spans):
                spans.append((0, name, [], [], first, first + len(text)))
    edges = sorted(s[4:] for s in spans)
    gaps = list(zip([0, *(e[1] for e in edges)], [*(e[0] for e in edges), len(own)], strict=True))
    while gaps:
        lo, hi = gaps.pop()
        if hi > lo and (f := _variant(own[lo:hi], texts, max_difference)):
            spans.append((*f[:4], lo + f[4], lo + f[5]))
            gaps += [(lo, lo + f[4]), (lo + f[5], hi)]
    packers = {name: packer for name, _, _, packer in _texts(texts)[0]}
    out = []
    for n, name, missing, added, first, after in spans:
        data = " ".join(own[first:after]).encode() + b"\n"
        alone, given = len(_templates(())[1].compress(data)), len(packers[name].compress(data))
        out.append((n, (given - alone) / alone, name, alone, given, missing, added, first, after))
    return out


SCHEMA = "doc_id long, block_no int, first_line int, n_lines int, license string, verdict string, size_alone int, size_given int, reduction double, n_missing int, n_added int, missing string, added string, block string, kind string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def scan_text(text: str, items: tuple[tuple[str, str], ...], max_difference: float = MAX_DIFFERENCE, top: int | None = None, texts: tuple[tuple[str, str], ...] = (), cues: str = CUES, wider: str | None = None) -> list[tuple]:
    """A tuple (NAMES without doc_id) for each license of each candidate block of a text, one at least for a block with
    one of ``cues`` (one around ``wider`` cues alone has a row only for a license); where a block has several, each with its
    own part of the block.

    Of templates that overlap the one with the fewest differing words wins (ties: the longer match, then the larger
    reduction), but a whole license of ``texts`` wins over what it contains. kind: text (a whole license), notice or
    opening. verdict: exact (no difference to a whole license or notice), opening (none to a license's first sentences,
    whose rest isn't there as the license words it), variant (differences of at most ``max_difference`` of the
    template's words) or unknown (then license and kind are null, and the differences are the fewest to one of the
    templates; of equally many the first by size reduction of the block). ``top`` confirms only so many templates of a
    block, first by size reduction; None, the default, all.
    """
    templates, _, known = _templates(items)
    by_name = {name: w for name, w, _ in templates}
    out = []
    for first, after, block in candidate_blocks(text, known, _texts(texts)[1] if texts else frozenset(), cues, wider):
        own = words(block)
        found = [(*f, "text") for f in whole(own, texts, max_difference)]
        taken = [f[7:9] for f in found]
        found += [(*f, "opening" if f[2] in OPENINGS else "notice") for f in confirmed(own, cue_places(block, either(cues, wider)), items, max_difference, top) if all(f[8] <= lo or f[7] >= hi for lo, hi in taken)]
        shown = [(first, after - first, block)] * len(found)
        if len(found) > 1:
            source = block if len(block) == len(low := block.lower()) else low
            ends = [m.span() for m in _WORD.finditer(low)]
            shown = []
            line, at = first, 0
            for lo, hi in sorted((ends[f[7]][0], ends[f[8] - 1][1]) for f in found):
                line, at = line + source.count("\n", at, lo), lo
                shown.append((line, source.count("\n", lo, hi) + 1, source[lo:hi]))
        for (n, gain, name, alone, given, missing, added, _, _, kind), (line, n_lines, part) in zip(sorted(found, key=lambda f: f[7]), shown, strict=True):
            verdict = "variant" if n else "opening" if kind == "opening" else "exact"
            out.append((len(out), line, n_lines, name, verdict, alone, given, round(-gain, 6), len(missing), len(added), " ".join(missing), " ".join(added), part, kind))
        if not found and re.search(cues, block):
            near = [(*differences(own, by_name[name]), gain, alone, given) for gain, name, alone, given in rank(block, items)[:top]]
            missing, added, gain, alone, given = min(near, key=lambda x: (len(x[0]) + len(x[1]), -x[2]))
            out.append((len(out), first, after - first, None, "unknown", alone, given, round(gain, 6), len(missing), len(added), " ".join(missing), " ".join(added), block, None))
    return out


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, max_difference: float = MAX_DIFFERENCE, top: int | None = None) -> DataFrame:
    """A row per license, or unknown candidate block, of ``docs`` (doc_id, text), of the whole texts.

    Whole licenses (TEXTS) are looked for too, unless ``templates`` are given. Cues are made from the templates where the
    fixed ones don't do (``wider_cues``; all of them where ``templates`` are given), so that none within ``max_difference``
    is missed. ``top`` and the verdicts: see ``scan_text``. A text of any length is scanned whole; around a
    cue only windows of a template's length are aligned. Ties between templates go to the first by name. A null or empty
    text, or one without a cue, gives no row; so does an empty table. Null ids are carried; repeated rows give their
    blocks again; other columns are left aside.
    """
    items, texts = tuple((templates or TEMPLATES).items()), () if templates else tuple(TEXTS.items())
    cues = cues_of(templates, max_difference) if templates else CUES
    wider = None if templates else wider_cues(TEMPLATES, CUES, max_difference)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[c.split()[1]] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = [(doc_id.as_py(), *r) for doc_id, text in zip(*batch.columns, strict=True) for r in scan_text(text.as_py(), items, max_difference, top, texts, cues, wider)]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in NAMES]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], NAMES)

    cued = docs.where(F.col("text").rlike(either(cues, wider))).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cued.mapInArrow(lean(run), SCHEMA)
