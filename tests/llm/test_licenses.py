"""License scans against a plain-Python version of the rules, and on a text of very many detections."""

import re
import time

from tidemark.llm import licenses

TEXTS = [
    "Under the MIT License. under the mit license; Apache License, Version 2 and CC-BY-NC",
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "SPDX-License-Identifier: GPL-3.0-or-later OR LGPL-2.1 under the GNU Lesser General Public License, version 2.1",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. All rights reserved.",
    "Neither the name of the Example Project nor the names of its contributors may be used to endorse or promote products",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "mit license mit license and mit  license, the unlicense", "no words of the kind", "", None, "ünder the MİT license cc by\tnc ccby nc", "licensed under the BSD license or see LICENSE file, for non-commercial use only",
]


def brute_force(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if x]
    w = f" {' '.join(words)} "
    base = sorted((i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    found = set()
    for label, pattern, keyword, priority in licenses.rules():
        if keyword in words:
            for m in re.finditer(f"(?<= )(?:{pattern})(?= )", w):
                first = w[: m.start()].count(" ") - 1
                found.add((first, first + m[0].count(" "), label, priority))

    def suppressed(x):
        for y in found - {x}:
            if y[0] <= x[0] and y[1] >= x[1] and (y[3] > x[3] or (y[3] == x[3] and (y[1] - y[0] > x[1] - x[0] or (y[:2] == x[:2] and y[2] < x[2])))):
                return True
        return False

    spans = sorted(x for x in found if not suppressed(x))
    labels = sorted({x[1] for x in base} | {x[2] for x in spans})
    best = 1.0 if base else max((x[3] / 100 for x in spans), default=0.0)
    return len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x[1] for x in base})), ",".join(labels), best, spans


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, [tuple(s) for s in r.spans]) for r in licenses.scanned(df).orderBy("doc_id").collect()]


def test_scan_against_brute_force(spark):
    # every written signature, with one word for each gap, between others
    written = [re.sub(r"\(\?:\\S\+ \)\{1,\d+\}", "gap ", p) for _, p, _, _ in licenses._text_rules()]
    plain = [re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", p).split("|")[0].replace(" ?", " ").replace("[cs]", "s").replace("?", "").replace("[1-4]", "4").replace("[05]", "0") for p in written]
    texts = TEXTS + [f"word {p}, word" for p in plain] + [" / ".join(plain)]
    got = scanned(spark, texts)
    assert got == [brute_force(t) for t in texts]
    assert sum(bool(x[7]) for x in got) > 150


def test_many_detections_in_one_text(spark):
    text = "mit license and foo, under the MIT license " * 8000
    began = time.perf_counter()
    r = scanned(spark, [text])[0]
    assert (r[0], r[1], len(r[7])) == (64_000, 8000, 16_000) and time.perf_counter() - began < 60
