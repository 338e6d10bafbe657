"""Notices that are no whole line and no whole text: wrapped ones within long documents, against all windows of words."""

import random
import re

from quern.llm import license_scan
from quern.llm.license_scan import TEMPLATES, bigrams_of, size_bounds

from .test_operators import docs_of


def plain_windows(text):
    """Of each template the best coefficient of all windows of words in its size bounds, by brute force."""
    w, out = re.findall("[a-z0-9]+", text.lower()), {}
    p = [" ".join(x) for x in zip(w, w[1:])]
    for name, template in TEMPLATES.items():
        b = set(bigrams_of(template))
        low, high = size_bounds(len(b), 0.8)
        best = 0.0
        for i in range(len(p)):
            seen, shared = set(), 0
            for x in p[i : i + high]:
                shared += x in b and x not in seen
                seen.add(x)
                best = max(best, 2 * shared / (len(seen) + len(b)))
        if best >= 0.8:
            out[name] = round(best, 9)
    return out


def wrapped(text, n):
    w = text.split()
    return "\n".join("# " + " ".join(w[i : i + n]) for i in range(0, len(w), n))


def prose(rng, n):
    words = [rng.choice("the of software license any granted stone river und version 2 0 mit".split()) for _ in range(n)]
    return wrapped(" ".join(words), 9)


def test_wrapped_notices_in_long_documents(spark):
    rng, rows, names = random.Random(4), [], sorted(TEMPLATES)
    for i, name in enumerate(names):
        rows.append((i, prose(rng, 200) + "\n" + wrapped(TEMPLATES[name], 12) + "\n" + prose(rng, 200)))
    got = {r.doc_id: {x.license: x for x in r.notices} for r in license_scan.scan(docs_of(spark, rows), keep=["doc_id"]).collect()}
    for i, name in enumerate(names):
        grams, words = bigrams_of(TEMPLATES[name]), re.findall("[a-z0-9]+", rows[i][1].lower())
        at = len(re.findall("[a-z0-9]+", "\n".join(rows[i][1].lower().split("\n")[:23])))
        line = 23 if f"{words[at - 1]} {words[at]}" in grams else 24  # of equal windows the first
        assert got[i][name].dice == 1.0 and got[i][name].line == (line if len(grams) > 1 else got[i][name].line), name


def test_windows_by_brute_force(spark):
    rng, rows, names = random.Random(5), [], sorted(TEMPLATES)
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 3)):
            words = TEMPLATES[rng.choice(names)].split()
            for _ in range(rng.randrange(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(["the", "free", "of the of the", "license", ""])
            parts += [prose(rng, rng.randrange(0, 60)), " ".join(words) if rng.random() < 0.3 else wrapped(" ".join(words), rng.randrange(3, 14))]
        rows.append((i, "\n".join([*parts, prose(rng, 30)])))
    got = {r.doc_id: {x.license: round(x.dice, 9) for x in r.notices} for r in license_scan.scan(docs_of(spark, rows), keep=["doc_id"]).collect()}
    assert got == {i: plain_windows(text) for i, text in rows} and sum(map(len, got.values())) > 30


def test_licence_lines_of_the_documents(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: {x.line: x.license for x in r.licenses} for r in license_scan.scan(docs, keep=["doc_id"]).collect()}
    kinds = {"Released under the MIT License.": "MIT-released", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    seen = set()
    for r in docs.collect():
        lines = (r.text or "").split("\n")
        for i, line in enumerate(lines, 1):
            if line in kinds:
                seen.add(line)
                assert got[r.doc_id].get(i if len(lines) > 1 else 0) == kinds[line], (r.doc_id, line)
    assert seen == set(kinds)


def test_usual_one_line_notices(spark):
    want = {"Released under the MIT License.": "MIT", "Licensed under the MIT license": "MIT", "This project is licensed under the MIT License.": "MIT", "Released under the ISC License.": "ISC", "Licensed under the ISC License": "ISC", "Licensed under the Apache License 2.0": "Apache", "Released under the Apache License, Version 2.0.": "Apache", "Released under the BSD 3-Clause License.": "BSD-3", "Released under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Mozilla Public License, version 2.0.": "MPL", "Released under CC BY 4.0.": "CC-BY-4.0"}
    got = {r.text: r.licenses for r in license_scan.scan(docs_of(spark, list(enumerate(want)))).collect()}
    for line, name in want.items():
        assert got[line] and got[line][0].license.startswith(name), line
