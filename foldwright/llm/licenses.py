"""Licence notices in texts, by Dice coefficient over word bigrams.

A text is read line by line, and as a whole. Each unit is normalised to its words of
a-z and 0-9 and compared to the templates by the sets of their bigrams. A unit of a bigrams
and a template of b can reach the threshold only if t / (2 - t) * b <= a <= (2 - t) / t * b,
so units of other sizes are never looked at; the rest meet the templates
through an index from bigram to template.

Notices inside a line, wrapped over lines or amid a longer text are found as windows of
words, for the templates and for the full texts and headers in `license_texts/`. A window
that reaches the threshold shares at least t / (2 - t) * b bigrams with the template, so
only texts and stretches with that many are searched.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from functools import cache
from importlib import resources
from math import ceil, floor

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The usual wording of short licence notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd": "Use of this source code is governed by a BSD-style license.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-nd-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0": "To the extent possible under law, the author has waived all copyright to this work.",
    "gpl-2": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mpl-2.0": "This work is subject to the terms of the Mozilla Public License, version 2.0.",
    "public-domain": "This work is in the public domain.",
    "reserved": "All rights reserved.",
}


@cache
def full_texts() -> dict[str, str]:
    """Full licence texts and their usual headers by name."""
    files = resources.files("foldwright.llm").joinpath("license_texts").iterdir()
    return {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in files if f.name.endswith(".txt")}


_ROWS = "doc_id bigint, line_no int, license string, shared bigint, unit_size bigint, license_size bigint"
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]
_KINDS = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]


def bigrams(normal: str) -> set:
    """Distinct word bigrams of a normalised text; a single word stands alone."""
    words = normal.split(" ") if normal else []
    return set(zip(words, words[1:])) if len(words) > 1 else set(words)


def normalised(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.translate(_LOWER)).strip(" ")


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class TemplateIndex:
    """Templates by bigram, with the sizes that a matching unit can have."""

    def __init__(self, templates: dict[str, str], threshold: Fraction):
        self.threshold = threshold
        self.sets = {name: bigrams(normalised(text)) for name, text in templates.items()}
        self.sets = {name: held for name, held in self.sets.items() if held}
        self.holders: dict = {}
        for name, held in self.sets.items():
            for b in held:
                self.holders.setdefault(b, []).append(name)
        low, high = threshold / (2 - threshold), (2 - threshold) / threshold
        self.sizes = {name: (low * len(held), high * len(held)) for name, held in self.sets.items()}
        self.least = min((a for a, _ in self.sizes.values()), default=Fraction(1))
        self.most = max((b for _, b in self.sizes.values()), default=Fraction(0))

    def matches(self, normal: str) -> list[tuple[str, int, int, int]]:
        """(template, shared, unit size, template size) of all templates that are near enough."""
        if normal.count(" ") < self.least - 1:
            return []
        own = bigrams(normal)
        if not self.least <= len(own) <= self.most:
            return []
        shared = Counter(name for b in own for name in self.holders.get(b, ()))
        out = []
        for name, n in shared.items():
            total = len(own) + len(self.sets[name])
            low, high = self.sizes[name]
            if low <= len(own) <= high and 2 * n * self.threshold.denominator >= total * self.threshold.numerator:
                out.append((name, n, len(own), len(self.sets[name])))
        return sorted(out)


class WindowIndex(TemplateIndex):
    """Templates of two words or more, sought as windows of a text's words.

    A window has at most (2 - t) / t times as many words as the template, less one of each.
    """

    def __init__(self, templates: dict[str, str], threshold: Fraction):
        several = {name: text for name, text in templates.items() if " " in normalised(text)}
        super().__init__(several, threshold)
        low, high = threshold / (2 - threshold), (2 - threshold) / threshold
        self.needed = {name: ceil(low * len(held)) for name, held in self.sets.items()}
        self.longest = {name: floor(high * normalised(several[name]).count(" ")) for name in self.sets}

    def windows(self, words: list[str]) -> list[tuple[str, int, int, int, int]]:
        """(template, first word, last word, shared, unit size) of windows that do not overlap, by template."""
        holders = self.holders
        hits = [(i, b) for i, b in enumerate(zip(words, words[1:])) if b in holders]
        shared = Counter(name for b in {b for _, b in hits} for name in holders[b])
        out, pairs = [], None
        for name in sorted(n for n, count in shared.items() if count >= self.needed[n]):
            pairs = pairs or list(zip(words, words[1:]))
            own = self.sets[name]
            out += [(name, *w) for w in self._of(name, pairs, [i for i, b in hits if b in own])]
        return out

    def _of(self, name: str, pairs: list, places: list[int]) -> Iterator[tuple[int, int, int, int]]:
        own, longest, needed = self.sets[name], self.longest[name], self.needed[name]
        num, den = self.threshold.numerator, self.threshold.denominator
        held: Counter = Counter()
        first, after, least = 0, 0, 0  # oldest place held, least place of the next window, next end to try
        for n, end in enumerate(places):
            if end < after:
                first = n + 1
                continue
            held[pairs[end]] += 1
            while end - places[first] >= longest:
                held[pairs[places[first]]] -= 1
                if not held[pairs[places[first]]]:
                    del held[pairs[places[first]]]
                first += 1
            if len(held) < needed or n < least:
                continue
            start, best = self._best(pairs, range(end, max(after, end - longest + 1) - 1, -1), own)
            if best < 0:
                # One more place adds at most 2 * den - num.
                least = n + ceil(-best / (2 * den - num))
                continue
            end, _ = self._best(pairs, range(start, min(len(pairs), start + longest)), own)
            start, _ = self._best(pairs, range(end, start - 1, -1), own)
            unit = set(pairs[start : end + 1])
            yield start, end + 1, len(unit & own), len(unit)
            after, first = end + 1, n + 1
            held.clear()

    def _best(self, pairs: list, path: range, own: set) -> tuple[int, int]:
        """Where a window along `path` ends best, and by how much it passes the threshold."""
        num, den = self.threshold.numerator, self.threshold.denominator
        seen: set = set()
        score = best = -num * len(own)
        at = path[0]
        for i in path:
            b = pairs[i]
            if b in seen:
                continue
            seen.add(b)
            score += 2 * den - num if b in own else -num
            if score > best:
                best, at = score, i
        return at, best


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    threshold: Fraction = Fraction(9, 10),
    texts: dict[str, str] | None = None,
) -> DataFrame:
    """(doc_id, line_no, license, shared, unit_size, license_size, dice) of every notice found.

    A line is what stands between newlines, numbered from 0; line_no is NULL for a text as a
    whole, which is compared too when it has several lines. Words are runs of a-z and 0-9
    after lower-casing A-Z, `dice` is 2 * shared / (unit_size + license_size), and every
    template that reaches `threshold` is a row. Then the templates and `texts` (by default the
    full texts and headers) are sought as windows of words, numbered by the line they begin in;
    a window is left out where a line it touches, or the whole, has that template already. A
    template of one word is compared with lines and wholes only.

    Defined cases: NULL, empty and word-free texts and units match nothing; a repeated row is
    scanned and reported again; rows without doc_id are reported under NULL; the longest texts
    are read whole; an empty table, or no templates and texts, give no rows. Other columns are not looked at.
    """

    sought = {**templates, **(full_texts() if texts is None else texts)}

    def inside(windows: WindowIndex, lines: list[str], found: list[tuple]) -> list[tuple]:
        split = [line.split() for line in lines]
        inner = windows.windows([w for own in split for w in own])
        if not inner:
            return []
        starts, total = [], 0
        for own in split:
            starts.append(total)
            total += len(own)
        known = {(number, name) for number, name, *_ in found}
        out = []
        for name, start, end, shared, size in inner:
            low, high = (bisect_right(starts, place) - 1 for place in (start, end))
            if (None, name) not in known and not any((n, name) in known for n in range(low, high + 1)):
                out.append((low, name, shared, size, len(windows.sets[name])))
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, windows = TemplateIndex(templates, threshold), WindowIndex(sought, threshold)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = pc.fill_null(part.column(1), "").cast(pa.large_string())
                texts = texts.take(pa.array(range(len(texts)), pa.int64()))
                normal = pc.replace_substring_regex(pc.ascii_lower(texts), "[^a-z0-9\n]+", " ")
                rows = []
                for key, text in zip(part.column(0).to_pylist(), normal.to_pylist()):
                    lines = text.split("\n")
                    found = [(number, *m) for number, line in enumerate(lines) for m in index.matches(line.strip(" "))]
                    if len(lines) > 1:
                        found += [(None, *m) for m in index.matches(re.sub(" *\n[ \n]*", " ", text).strip(" "))]
                    rows += [(key, *f) for f in found + inside(windows, lines, found)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], names=_NAMES
                )

    found = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scan, _ROWS)
    return found.withColumn("dice", 2.0 * F.col("shared") / (F.col("unit_size") + F.col("license_size")))
