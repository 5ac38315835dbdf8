"""Divergence cube, filter folds and toxicity against plain versions, with their edge cases."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import divergence, folds, toxicity
from tidemark.llm.common import LOWER, shared_dir

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
CLASH = ["term", "n", "docs", "whole", "block", "k", "i", "j", "other", "part", "item", "value", "rank", "mask", "digest", "good", "toxic", "quality", "salt", "own", "first", "cells", "steps", "share", "score", "held_out"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def clashing(df):
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASH if c not in df.columns})


def some_documents(n=260, seed=3):
    r = random.Random(seed)
    words = ["alpha", "Beta", "gämma", "ßtrange", "delta$", "42", "e", "Zeta", "eta|theta", "iota", "漢字", "k'appa"]
    rows = []
    for i in range(n):
        lang, source = r.choice(["en", "en", "de", None]), r.choice(["s1", "s1", "s2", "é", None])
        text = " ".join(r.choices(words, k=r.randint(0, 40), weights=range(1, len(words) + 1)))
        rows.append((i, r.choice([text, text, text, None, ""]), lang, source))
    rows += [(n, rows[0][1], "en", "s1"), (None, rows[0][1], "en", "s9"), (n + 1, " ".join(words * 400), "en", "s2"), (n + 1, " ".join(words * 400), "en", "s2"), (n + 2, "lonely", "xx", "s1"), (n + 3, "words", "yy", "a"), (n + 4, "", "yy", "b")]
    return rows


def plain_divergences(rows, least=30):
    terms = [(lang or "", source or "", Counter(WORD.findall(lower(text)))) for _, text, lang, source in rows]
    docs, whole, own, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, c in terms:
        groups.add((lang, source))
        docs[lang].update(c.keys())
        whole[lang].update(c)
        own[lang, source].update(c)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, k in docs[lang].items() if k >= least]
        total = sum(whole[lang][t] for t in kept)
        p = {g: {t: 1 + 10**9 * (own[g][t] + 5) // (sum(own[g][x] for x in kept) + 5 * len(kept)) for t in kept} for g in groups if g[0] == lang}
        q = {t: 1 + 10**9 * (whole[lang][t] + 5) // (total + 5 * len(kept)) for t in kept}
        for g, mine in p.items():
            pairs = [(h[1], sum(abs(mine[t] - p[h][t]) for t in kept)) for h in p if h != g]
            named = [(t, mine[t] - q[t]) for t in kept if own[g][t] > 0 and mine[t] > q[t]]
            for part, found in (("pair", pairs), ("term", named)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, g[1], part, item, v, k) for k, (item, v) in enumerate(found, 1) if part == "pair" or k <= 50}
    return out


@pytest.mark.parametrize(("groups", "terms", "piece"), [(8, 4096, 1 << 22), (1, 2, 64)])
def test_divergences_equal_a_plain_version_in_one_cell_and_in_many(spark, monkeypatch, groups, terms, piece):
    monkeypatch.setattr(divergence, "GROUPS", groups)
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "PIECE", piece)
    rows = some_documents()
    found = divergence.divergences(clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))).collect()
    assert len(found) == len({(r.lang, r.source, r.part, r.item) for r in found})
    assert {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in found} == plain_divergences(rows)
    assert {("xx", "s1"), ("yy", "a")} & {(r.lang, r.source) for r in found} == {("yy", "a")}  # an only source has no pairs


def test_divergences_of_nothing(spark):
    assert divergence.divergences(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_counts_are_handed_on_by_their_bytes():
    """Few but very long terms: a task hands their counts on long before the last of its texts."""
    read = []

    def batches():
        for k in range(400):
            read.append(k)
            yield pa.RecordBatch.from_pydict({"lang": ["en"], "source": ["a"], "text": [f"{k:04d}".translate(str.maketrans("0123456789", "abcdefghij")) * 20_000]})

    first = next(b for b in divergence._count(batches()) if b.column("term").null_count == 0)
    assert len(read) * 80_000 < 2 * divergence.GATHERED and first.num_rows <= len(read)


def test_divergences_write_few_parts(spark):
    """Many shuffle partitions that nothing coalesces don't become as many files."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    known = set(Path(shared_dir(spark)).glob("tidemark/*"))
    try:
        for k, v in zip(before, ("96", "false"), strict=True):
            spark.conf.set(k, v)
        rows = some_documents()
        found = divergence.divergences(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
        most = max(spark.sparkContext.defaultParallelism, 96 // divergence.JOINED)
        assert found.rdd.getNumPartitions() <= most
        assert {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in found.collect()} == plain_divergences(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    written = set(Path(shared_dir(spark)).glob("tidemark/*")) - known
    assert len(written) == 3 and all(len(list(d.glob("part-*"))) <= most for d in written)


def test_scaled_is_exact_beyond_sixty_four_bits():
    whole = np.array([8_999_999_999_999_999, 7, 9_000_000_000_000_000])
    count = np.array([8_999_999_999_999_998, 7, 123_456_789_012_345])
    assert divergence.scaled(count, whole).tolist() == [1 + 10**9 * int(c) // int(w) for c, w in zip(count, whole, strict=True)]


def plain_interactions(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    cells = Counter()
    for i, text, _, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = frozenset(x for x, f in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), re.search(r"[#$%&*|]", text) is not None, i is not None and i > least[text]), strict=True) if f)
        cells[source or "", fails, i in good, i in toxic] += 1
    out, by_filter = {}, Counter()
    for part in {c[0] for c in cells}:
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                row = [0] * 6
                for (p, fails, g, t), n in cells.items():
                    if p != part:
                        continue
                    stands = not set(order[:k]) & fails
                    row[0] += n * (stands and f not in fails)
                    row[1] += n * (stands and f in fails)
                    row[2] += n * (not stands and f in fails)
                    row[3] += n * (fails == {f})
                    row[4] += n * (stands and f in fails and g)
                    row[5] += n * (stands and f in fails and t)
                out[part, order, k + 1] = row
                by_filter[part, f] += row[1]
    return {(*key, *row, by_filter[key[0], key[1][key[2] - 1]]) for key, row in out.items()}


def test_interactions_equal_a_plain_version(spark):
    r = random.Random(5)
    rows = some_documents()
    for i in range(60):
        body = " ".join(f"w{r.randint(0, r.choice([90, 400]))}" for _ in range(r.choice([150, 260])))
        rows.append((1000 + i, r.choice([body, body.upper(), body + " # mark", rows[-1][1] or ""]), "en", r.choice(["s1", "s3", None])))
    rows += [(1000, "repeated id", "en", "s1"), (1000, "repeated id", "en", "s3"), (1001, "repeated id", "en", "s1"), (None, "repeated id", "en", "s1"), (None, "repeated id", "en", "s1"), (5000, "A" * 300_000, "en", "s1")]
    labels = [(r.randint(0, 1100), r.choice([0, 1, None]), r.choice([0, 1])) for _ in range(400)] + [(None, 1, 1)]
    found = folds.interactions(clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = found.collect()
    assert {tuple(x) for x in found} == plain_interactions(rows, labels) and len(found) == 600 * len({x.part for x in found})


def test_interactions_of_nothing(spark):
    empty, none = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert folds.interactions(empty, none).count() == 0
    assert folds.interactions(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string"), none).count() == 600


ORDINARY, RUDE = ["river", "stone", "walks", "under", "bridge", "evening", "quiet", "ñandú", "light", "garden"], ["blarg", "blargon", "snurfle"]


def labelled(n=240, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = [r.choice(ORDINARY) + r.choice(["", "s", "ing"]) for _ in range(r.randint(5, 60))]
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            words[r.randrange(len(words))] = r.choice(RUDE) + r.choice(["", "$$$", "!"])
        out.append((i, " ".join(words), int(bad)))
    return out


def plain_likelihood(counts, word):
    """The two log-likelihoods of one word, straight from the definition: counts of words by class, spelled by interpolated Kneser-Ney."""
    order, shared = toxicity.ORDER, toxicity.SHARED
    gram = lambda w: [(b"\1" * (order - 1) + w + b"\2")[k : k + order] for k in range(len(w) + 1)]
    top = [Counter(g for w, n in counts[c].items() if n for g in gram(w)) for c in (0, 1)]
    discount = lambda xs: min(max(sum(x == 1 for x in xs) / max(sum(x == 1 for x in xs) + 2 * sum(x == 2 for x in xs), 1), 0.1), 0.95)
    levels, raw = {order: top}, top
    for k in range(order - 1, 0, -1):
        if k == shared:
            raw = [raw[0] + raw[1]]
        low, kinds = [Counter() for _ in raw], [Counter() for _ in raw]
        for c, one in enumerate(raw):
            for g, n in one.items():
                low[c][g[1:]] += n
                kinds[c][g[1:]] += 1
        levels[k] = [Counter({g: low[c][g] if g[0] == 1 else kinds[c][g] for g in low[c]}) for c in range(len(raw))]
        raw = low
    out = []
    for c in (0, 1):
        spelled = 0.0
        for g in gram(word):
            p = 1 / 256
            for k in range(1, order + 1):
                table = levels[k][c if k > shared else 0]
                d = discount(list(table.values()))
                h = g[order - k : order - 1]
                own = [n for x, n in table.items() if x[:-1] == h]
                if own:
                    p = max(table[g[order - k :]] - d, 0) / sum(own) + d * len(own) / sum(own) * p
            spelled += math.log(p)
        d, n = discount(list(counts[c].values())), sum(counts[c].values())
        share = max(counts[c][word] - d, 0) / n
        out.append(math.log(share + d * len(counts[c]) / n * math.exp(spelled)))
    return out


def test_likelihoods_equal_the_definition():
    counts = [Counter({b"stone": 3, b"stones": 1, b"bridge": 2, b"under": 1, "ñandú".encode(): 1}), Counter({b"stone": 1, b"blarg": 4, b"blargon": 1, b"under": 1, b"blargs": 2})]
    words = sorted(counts[0].keys() | counts[1].keys())
    data, offsets = toxicity._joined(words)
    keys, symbols = toxicity.grams(data, offsets[:-1], offsets[1:])
    table = np.array([[counts[c][w] for c in (0, 1)] for w in words], float)
    from tidemark.llm.common import Rolling

    models = toxicity.Models(Rolling(data).of(offsets[:-1], offsets[1:]), table, keys, symbols)
    asked = [b"stone", b"blarg", b"blargish", b"zzz", b"undergarden", b"s"]
    data, offsets = toxicity._joined(asked)
    found = toxicity.Reader(models).words(LOWER[data], offsets[:-1], offsets[1:])
    assert np.allclose(found[:, :2] * toxicity.UNIT, [plain_likelihood(counts, w) for w in asked], rtol=1e-5)
    assert found[:, 2].tolist() == [len(w) + 1 for w in asked]


def test_an_expression_that_neither_class_knows_tells_little():
    rows = labelled()
    detector = toxicity.Detector([t.encode() for _, t, _ in rows], np.array([y == 1 for _, _, y in rows]), 0.25)
    data, offsets = toxicity._joined([b"xqvzw xqvzw", b"blarg blarg", b"river stone"])
    found = detector.reader().evidence(data, offsets)
    apart = found[:, 1] - found[:, 0]
    assert apart[1] > 4 * abs(apart[0]) and apart[2] < 0


def test_reading_in_parts_changes_nothing(monkeypatch):
    rows = labelled()
    detector = toxicity.Detector([t.encode() for _, t, _ in rows], np.array([y == 1 for _, _, y in rows]), 0.25)
    texts = [" ".join(t for _, t, _ in rows).encode(), b"", rows[0][1].encode(), b"$ 1 2", "Ñ".encode() * 5000]
    whole = detector.reader().evidence(*toxicity._joined(texts))
    monkeypatch.setattr(toxicity, "PIECE", 97)
    monkeypatch.setattr(toxicity, "REMEMBERED", 5)
    assert np.allclose(whole, detector.reader().evidence(*toxicity._joined(texts)))
    assert (whole[[1, 3]] == 0).all()


def test_toxicity_finds_held_out_texts_and_bears_edges(spark):
    rows = labelled()
    extra = [(None, rows[0][1]), (7, rows[7][1]), (900, None), (901, ""), (902, "x" * 200_000), (903, "\t\n"), (904, "!! ## 漢字")]
    docs = clashing(spark.createDataFrame([(i, t) for i, t, _ in rows] + extra, "doc_id long, text string"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (7, 0)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in out)
    by_id = defaultdict(list)
    for r in out:
        by_id[r.doc_id].append(r)
    held = [(i, y) for i, _, y in rows if by_id[i][0].held_out]
    assert len(held) > 20 and sum(by_id[i][0].predicted == y for i, y in held) >= 0.97 * len(held)
    assert by_id[None][0].held_out and by_id[None][0].score == by_id[0][0].score
    assert by_id[900][0].score == by_id[901][0].score == by_id[903][0].score
    assert len(by_id[7]) == 2 and len({r.score for r in by_id[7]}) == 1
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.01}
