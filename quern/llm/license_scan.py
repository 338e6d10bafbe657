"""License scans: normalised text against licence templates by the Dice coefficient over word bigrams.

A unit of text (the whole text, and each of its lines) is compared with a
template by 2 |A and B| / (|A| + |B|) of their sets of word bigrams. For the
coefficient to reach a threshold t, the smaller set must have at least
t / (2 - t) times as many bigrams as the larger, so a unit's size alone leaves
few candidate templates, for most units none. All of it is SQL expressions,
without a shuffle.

A notice that runs over several lines, or stands within one, is none of these
units. So each template is also compared with all windows of consecutive words of
the text, of as many bigrams as a unit of its size bounds. Leaving out an end of a
window that is no bigram of the template never lowers the coefficient, so only
windows from one such bigram to another are looked at, and of those only where
enough of them lie close together.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .license_texts import TEXTS

# Short notices and texts of common licences, by their usual identifiers.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause-notice": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause-notice": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-header": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "GPL-2.0": "Licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "Licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "ISC-notice": "Licensed under the ISC License.",
    "ISC-released": "Released under the ISC License.",
    "MIT": "MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-project": "This project is licensed under the MIT License.",
    "MIT-released": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0": "Licensed under the Mozilla Public License, version 2.0.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
} | TEXTS


EMPTY = "cast(array() as array<struct<license:string,line:int,dice:double>>)"

#: Templates of as many bigrams are looked for by counts of their words, others by single words.
LONG = 300


def bigrams_of(text: str) -> list[str]:
    """Distinct word bigrams of a text as bigrams() forms them; a single word is one."""
    words = re.findall("[a-z0-9]+", text.lower())
    return sorted({" ".join(p) for p in zip(words, words[1:], strict=False)} or set(words))


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Least and most bigrams of a unit whose coefficient with a template of n bigrams can reach the threshold."""
    low = threshold / (2 - threshold)
    return max(1, math.ceil(n * low - 1e-9)), math.floor(n / low + 1e-9)


# The expressions are SQL text: they nest deep and repeat for each template, and are parsed at once.


def let(x: str, name: str, body: str) -> str:
    """body with x, computed once, under a name."""
    return f"element_at(transform(array({x}), {name} -> {body}), 1)"


def words(text: str) -> str:
    """Lower-case words of ASCII letters and digits, in order."""
    return f"regexp_extract_all(lower({text}), '[a-z0-9]+', 0)"


def pairs(w: str) -> str:
    """Pairs of adjacent words in order."""
    return f"zip_with(slice({w}, 1, greatest(size({w}) - 1, 0)), slice({w}, 2, greatest(size({w}) - 1, 0)), (a, b) -> concat(a, ' ', b))"


def bigrams(w: str) -> str:
    """Distinct pairs of adjacent words; a single word stands for itself."""
    return f"if(size({w}) > 1, array_distinct({pairs(w)}), {w})"


def listed(grams: list[str]) -> str:
    return ", ".join(f"'{g}'" for g in grams)


def best_window(name: str, grams: list[str], threshold: float) -> str:
    """(license, at, dice) of the window of the bigrams ``p`` that is most like a template, null if none reaches the threshold.

    hits (i, g) are the bigrams of ``p`` that any template has, with their places from 0.
    Of windows the greatest (dice, place, least) is taken: place is minus that of the
    window's first bigram, so that of equal windows the first is the greatest, and least
    is minus its length. Starts are taken by the number of the template's bigrams ahead,
    and left out once that can't lead to a better window.
    """
    n = len(grams)
    low, high = size_bounds(n, threshold)
    distinct = lambda x: f"size(array_distinct(transform({x}, x -> x.g)))"
    ahead = f"filter(slice(h, k, {high}), x -> x.i < element_at(h, k).i + {high})"
    started = let(ahead, "r", f"named_struct('s', {distinct('r')}, 'k', -k, 'r', r)")
    window = let(f"element_at(run, e).i - element_at(run, 1).i + 1", "len", f"named_struct('dice', 2D * {distinct('slice(run, 1, e)')} / (size(array_distinct(slice(p, element_at(run, 1).i + 1, len))) + {n}), 'place', -element_at(run, 1).i, 'least', -len)")
    ends = f"filter(sequence({low}, size(run)), e -> 2D * e / (e + {n}) >= coalesce(best.dice, {threshold - 1e-9}D))"
    windows = let("start.r", "run", f"greatest(best, array_max(transform({ends}, e -> {window})))")
    places = f"filter(sequence(1, size(h) - {low - 1}), k -> element_at(h, k + {low - 1}).i - element_at(h, k).i < {high})"
    starts = f"filter(transform({places}, k -> {started}), x -> x.s >= {low})"
    searched = f"aggregate(reverse(array_sort({starts})), cast(null as struct<dice:double,place:int,least:int>), (best, start) -> if(best is null or 2D * start.s / (start.s + {n}) >= best.dice, {windows}, best))"
    found = let(f"filter(hits, x -> x.g in ({listed(grams)}))", "h", f"if(size(h) >= {low}, {searched}, null)")
    return let(found, "f", f"if(f.dice >= {threshold}D, named_struct('license', '{name}', 'at', -f.place, 'dice', f.dice), null)")


def anchors(sets: dict[str, list[str]], threshold: float) -> list[list[str]]:
    """Few lists of words; a text holds all words of one of them if any unit of it reaches the threshold with any template.

    Such a unit shares at least t / (2 - t) of the template's bigrams, so it shares one
    of any of them that are more than the rest. Words of five letters or more are added,
    the most useful first, until those among a template's bigrams that hold one are as
    many; each is a list of its own. Where a template has too few such words, a unit
    without them shares so many of its other bigrams that some words can't be missing:
    these are one list. Only where there are none shorter words are added as well.
    """
    least = {name: size_bounds(len(b), threshold)[0] for name, b in sets.items()}
    need = {name: len(b) - least[name] + 1 for name, b in sets.items()}
    by_word: dict[str, dict[str, set[int]]] = {}
    for name, b in sets.items():
        for i, x in enumerate(b):
            for w in x.split():
                by_word.setdefault(w, {}).setdefault(name, set()).add(i)
    chosen: list[list[str]] = []
    held: dict[str, set[int]] = {name: set() for name in sets}

    def gain(w: str) -> int:
        return sum(min(need[name], len(held[name] | places)) - min(need[name], len(held[name])) for name, places in by_word[w].items())

    def add(some: list[str]) -> bool:
        best = max(some, key=lambda w: (gain(w), len(w), w), default="")
        if not best or not gain(best):
            return False
        chosen.append([best])
        for name, places in by_word[best].items():
            held[name] |= places
        return True

    long = [w for w in by_word if len(w) >= 5 and not w.isdigit()]
    while add(long):
        pass
    for name, b in sets.items():
        while len(held[name]) < need[name]:
            rest = len(b) - len(held[name])
            required = sorted(w for w, there in by_word.items() if rest - len(there.get(name, set()) - held[name]) < least[name])
            if required:
                chosen.append(required)
                break
            add(list(by_word))
    return chosen


def counted_words(grams: list[str], threshold: float, least: int = 3) -> tuple[list[str], int]:
    """Words and how many of them a unit that reaches the threshold with a long template holds at least.

    Of any m of the template's n bigrams the unit shares m less n (1 - t / (2 - t)). The
    words are those of five letters or more that stand in most bigrams, as many as it
    takes until no fewer than ``least`` of them can stand in the bigrams that are shared.
    """
    n = len(grams)
    by_word: dict[str, set[int]] = {}
    for i, x in enumerate(grams):
        for w in x.split():
            by_word.setdefault(w, set()).add(i)
    held, covered, sizes, k = [], set(), [], 0
    for w in sorted(by_word, key=lambda w: (len(w) < 5, -len(by_word[w]), w)):
        held.append(w)
        covered |= by_word[w]
        sizes = sorted([*sizes, len(by_word[w])], reverse=True)
        wanted, k = len(covered) - (n - size_bounds(n, threshold)[0]), 0
        while wanted > sum(sizes[:k]):
            k += 1
        if k >= least:
            break
    return held, max(1, k)


def scan(docs: DataFrame, *, text_col: str = "text", threshold: float = 0.8, templates: dict[str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds licenses and notices, arrays of (license, line, dice), to ``keep`` (by default all columns).

    licenses: For each unit the template of the highest coefficient (of equal ones the first by
    identifier) is listed if that reaches ``threshold``. line is 0 for the whole text,
    else the number of the line from 1; a text of one line is one unit. Texts without a
    licence, null and empty ones have an empty array. Repeated rows give equal rows.

    notices: Each template of which a window of words reaches ``threshold``, by
    identifier, with the coefficient of its best window (of equal ones the first, then the
    shortest) and the line where that starts. Lines don't bound windows; a template of one word has none.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("licenses", "notices")]
    own = fresh(docs, "__text")
    sets = {name.replace("\\", "\\\\").replace("'", "\\'"): bigrams_of(t) for name, t in sorted((TEMPLATES if templates is None else templates).items())}
    if not sets:
        return docs.select(*keep, F.expr(EMPTY).alias("licenses"), F.expr(EMPTY).alias("notices"))
    text = f"coalesce(`{own}`, '')"
    lists = anchors({name: b for name, b in sets.items() if len(b) < LONG}, threshold)
    gates = [(size_bounds(len(b), threshold)[0], *counted_words(b, threshold)) for b in sets.values() if len(b) >= LONG]

    def anchored(t: str, counted: bool) -> str:
        """Whether the text can hold a licence; without counting words a long text always can."""
        found = [" and ".join(f"contains(low, '{w}')" for w in held) for held in lists]
        # so many bigrams of two letters and a space at least
        found += [f"length(low) >= {2 * least}" + (f" and size(filter(split('{' '.join(held)}', ' '), w -> contains(low, w))) >= {k}" if counted else "") for least, held, k in gates]
        return let(f"lower({t})", "low", " or ".join(f"({x})" for x in found) or "false")

    def compared(i: int, name: str, grams: list[str]) -> str:
        low, high = size_bounds(len(grams), threshold)
        return f"if(size(u.b) between {low} and {high}, named_struct('dice', 2D * size(array_intersect(u.b, array({listed(grams)}))) / (size(u.b) + {len(grams)}), 'order', {-i}, 'license', '{name}', 'line', u.line), null)"

    lines = f"split({text}, chr(10))"
    by_line = f"filter(transform({lines}, (t, i) -> named_struct('line', i + 1, 'text', t)), u -> {anchored('u.text', False)})"
    units = f"concat(array(named_struct('line', 0, 'text', {text})), if(size({lines}) > 1, {by_line}, cast(array() as array<struct<line:int,text:string>>)))"
    sized = f"transform({units}, v -> {let(words('v.text'), 'w', f"named_struct('line', v.line, 'b', {bigrams('w')})")})"
    options = [compared(i, name, grams) for i, (name, grams) in enumerate(sets.items())]
    best = f"filter(transform({sized}, u -> greatest({', '.join([*options, 'null'])})), x -> x.dice >= {threshold}D)"
    found = f"transform({best}, x -> named_struct('license', x.license, 'line', x.line, 'dice', x.dice))"
    union = sorted({g for grams in sets.values() for g in grams})
    hits = f"filter(transform(p, (g, i) -> if(g in ({listed(union)}), named_struct('i', i, 'g', g), null)), x -> x is not null)"
    line_of = "aggregate(sizes, named_struct('n', 0, 'line', 0), (a, n) -> if(a.n > y.at, a, named_struct('n', a.n + n, 'line', a.line + 1))).line"
    placed = let(f"transform({lines}, t -> size({words('t')}))", "sizes", f"transform(seen, y -> named_struct('license', y.license, 'line', {line_of}, 'dice', y.dice))")
    windows = ", ".join(best_window(name, grams, threshold) for name, grams in sets.items())
    seen = let(hits, "hits", f"filter(array({windows}), x -> x is not null)")
    runs = let(words(text), "w", let(pairs("w"), "p", let(seen, "seen", f"if(size(seen) > 0, {placed}, {EMPTY})")))
    held = fresh(docs, "__found")
    both = F.expr(f"if({anchored(text, True)}, named_struct('licenses', {found}, 'notices', {runs}), null)")
    looked = docs.select(*keep, F.col(text_col).alias(own)).select(*keep, both.alias(held))
    return looked.select(*keep, *[F.coalesce(F.col(held)[c], F.expr(EMPTY)).alias(c) for c in ("licenses", "notices")])
