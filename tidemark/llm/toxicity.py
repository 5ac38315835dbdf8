"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary texts.

A text is its runs of letters. Each class has its own counts of words; what they leave goes to a word's spelling, byte
by byte between a begin and an end mark, which learns from each distinct word once. Of the spelling's orders the
longest hold continuation counts of their class, the SHARED lowest those of both classes together: an expression that
is rare in both falls back on what they share, so it tells nothing about the class, and what remains is the evidence
of expressions that one class uses and the other doesn't. Log-likelihoods are divided by the symbols read, over the
whole text and over each run of a few words; a logistic curve turns their differences into a probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, NO_LETTER, Rolling, id_crc, long_cuts, pieces, small_batches, text_bytes, words_of

#: Bytes of the longest n-gram (8 at most: n-grams are kept as 64-bit numbers, not as hashes), orders that both classes
#: share, words in a stretch (a word, a phrase, a sentence).
ORDER, SHARED, WINDOWS = 7, 3, (1, 3, 12)
#: The models are fitted on so many labelled texts of each class at most, of so many bytes at most each; texts to score have no bound.
FIT_ROWS, FIT_BYTES = 2000, 1 << 16
#: Score from which a text counts as toxic.
TOXIC = 0.5
#: How much more a missed toxic text counts in the curve's fit than an ordinary one that is flagged.
MISSED = 3.0
#: Bytes that are worked on at once; distinct words whose likelihoods a task remembers.
PIECE, REMEMBERED = 1 << 21, 1 << 18
BEGIN, END = 1, 2
#: Log-likelihoods of words are kept as whole numbers of this share, so that sums don't depend on how texts are batched.
UNIT = 2.0**-24


def grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each symbol of each word, as a number of its ORDER bytes, and the words' numbers of symbols."""
    sizes = end - start
    whole = sizes + ORDER  # ORDER - 1 begin marks, the bytes, an end mark
    first = np.cumsum(whole) - whole
    out = np.full(int(whole.sum()), BEGIN, np.uint8)
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(first + ORDER - 1, sizes) + place] = data[np.repeat(start, sizes) + place]
    out[first + whole - 1] = END
    keys = np.zeros(len(out), np.uint64)
    wide = out.astype(np.uint64)
    for j in range(ORDER):
        keys[j:] |= wide[: len(out) - j] << np.uint64(8 * j)
    symbols = sizes + 1
    place = np.arange(int(symbols.sum())) - np.repeat(np.cumsum(symbols) - symbols, symbols)
    return keys[np.repeat(first + ORDER - 1, symbols) + place], symbols


def _low(keys: np.ndarray, k: int) -> np.ndarray:
    """The last k bytes."""
    return keys & np.uint64((1 << 8 * k) - 1)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their sums of counts (one column for each class)."""
    out, place = np.unique(keys, return_inverse=True)
    total = np.zeros((len(out), counts.shape[1]))
    for c in range(counts.shape[1]):
        total[:, c] = np.bincount(place, counts[:, c], len(out))
    return out, total


def _discount(counts: np.ndarray) -> np.ndarray:
    """What each count of a class gives up: n1 / (n1 + 2 n2), from how many counts are 1 and 2."""
    once, twice = (counts == 1).sum(axis=0), (counts == 2).sum(axis=0)
    return np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.95)


class Level:
    """One order: the discounted share of each n-gram among its context's, and the weight that a context leaves to the order below."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        discount = _discount(counts)
        contexts, place = np.unique(keys >> np.uint64(8), return_inverse=True)
        whole = np.stack([np.bincount(place, counts[:, c], len(contexts)) for c in range(counts.shape[1])], axis=1)
        kinds = np.stack([np.bincount(place, counts[:, c] > 0, len(contexts)) for c in range(counts.shape[1])], axis=1)
        size = np.maximum(whole, 1)
        self.keys, self.contexts = keys, contexts
        self.share = (np.maximum(counts - discount, 0) / size[place]).astype(np.float32)
        # a context that a class never saw leaves all of it
        self.rest = np.where(whole > 0, discount * kinds / size, 1).astype(np.float32)

    def of(self, keys: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Probabilities of n-grams, given those of the order below."""
        share, rest = _found(self.keys, self.share, keys, 0.0), _found(self.contexts, self.rest, keys >> np.uint64(8), 1.0)
        return share + rest * below


def _found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, other: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(asked), values.shape[1]), other)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where((keys[at] == asked)[:, None], values[at], other).astype(np.float64)


class Models:
    """Both classes' probabilities; column 0 is the ordinary class, column 1 the toxic one."""

    def __init__(self, names: np.ndarray, counts: np.ndarray, keys: np.ndarray, symbols: np.ndarray):
        # a word's own count in a class; what it leaves goes to its spelling, which learns from each distinct word once
        n, kinds = np.maximum(counts.sum(axis=0), 1), (counts > 0).sum(axis=0)
        discount = _discount(counts)
        order = np.argsort(names)
        self.names, self.share, self.rest = names[order], (np.maximum(counts - discount, 0) / n)[order], np.where(kinds > 0, discount * kinds / n, 1)
        above, raw = _summed(keys, np.repeat(counts > 0, symbols, axis=0).astype(float))
        self.levels = [Level(above, raw)]
        for k in range(ORDER - 1, 0, -1):
            low, place = np.unique(_low(above, k), return_inverse=True)
            # continuations: n-grams one longer that end so; nothing stands before a begin mark, so those keep their counts
            by_class = lambda x: np.stack([np.bincount(place, x[:, c], len(low)) for c in range(x.shape[1])], axis=1)  # noqa: B023, E731
            if k == SHARED:
                raw = raw.sum(axis=1, keepdims=True)
            kinds, raw = by_class(raw > 0), by_class(raw)
            begins = (low >> np.uint64(8 * (k - 1))) == BEGIN
            self.levels.append(Level(low, np.where(begins[:, None], raw, kinds).astype(float)))
            above = low

    def log_likelihoods(self, names: np.ndarray, keys: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Natural logarithms of each word's probability in both classes."""
        p = np.full((len(keys), 1), 1 / 256)
        for k in range(1, ORDER + 1):
            p = self.levels[ORDER - k].of(_low(keys, k), p)
        spelled = np.add.reduceat(np.log(p), np.cumsum(symbols) - symbols, axis=0)
        share = _found(self.names, self.share, names, 0.0)
        return np.logaddexp(np.log(np.maximum(share, 1e-300)), np.log(self.rest) + spelled)


class Reader:
    """A text's evidence under the models; remembers the words that it has met, so that each is spelled once."""

    def __init__(self, models: Models):
        self.models = models
        self.known, self.values = np.zeros(0, np.uint64), np.zeros((0, 3), np.int64)

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Per word its log-likelihoods as an ordinary and as a toxic one, in UNITs, and its symbols."""
        hashes = Rolling(data).of(start, end)
        own, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, own), max(len(self.known) - 1, 0))
        new = np.ones(len(own), bool) if not len(self.known) else self.known[at] != own
        fresh = np.zeros((int(new.sum()), 3), np.int64)
        if len(fresh):
            keys, symbols = grams(data, start[first[new]], end[first[new]])
            fresh[:, :2], fresh[:, 2] = np.rint(self.models.log_likelihoods(own[new], keys, symbols) / UNIT), symbols
        out = np.zeros((len(own), 3), np.int64)
        out[new] = fresh
        if not new.all():
            out[~new] = self.values[at[~new]]
        if len(fresh):
            keys, values = np.concatenate([self.known, own[new]]), np.concatenate([self.values, fresh])
            if len(keys) > REMEMBERED:
                keys, values = own, out
            order = np.argsort(keys)
            self.known, self.values = keys[order], values[order]
        return out[place]

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per text: log-likelihoods for each symbol as an ordinary and as a toxic text, the number of words, and the largest difference for each symbol in a stretch of each length."""
        out = np.zeros((len(offsets) - 1, 3 + len(WINDOWS)))
        data = LOWER[data]
        for at, to in pieces(offsets, PIECE):
            lo, hi = int(offsets[at]), int(offsets[to])
            if hi - lo <= 2 * PIECE:
                part = data[lo:hi]
                start, end, first = words_of(part, offsets[at : to + 1] - lo, NO_LETTER)
                out[at:to] = _evidence(self.words(part, start, end), first)
            else:  # one long text, read in parts
                cuts, found = long_cuts(data, lo, hi, PIECE, NO_LETTER), []
                for i, j in zip(cuts, cuts[1:], strict=False):
                    start, end, _ = words_of(data[i:j], np.array([0, j - i]), NO_LETTER)
                    found.append(self.words(data[i:j], start, end))
                found = np.concatenate(found)
                out[at:to] = _evidence(found, np.array([0, len(found)]))
        return out


def _evidence(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(words, axis=0)])
    n = np.diff(first)
    whole = sums[first[1:]] - sums[first[:-1]]
    out = np.zeros((len(n), 3 + len(WINDOWS)))
    out[:, :2] = UNIT * whole[:, :2] / np.maximum(whole[:, 2:], 1)
    out[:, 2] = n
    for k, window in enumerate(WINDOWS, 3):
        short = (n > 0) & (n <= window)
        out[short, k] = (out[:, 1] - out[:, 0])[short]
        long = np.flatnonzero(n > window)
        if len(long):
            run = sums[window:] - sums[:-window]
            rate = UNIT * (run[:, 1] - run[:, 0]) / np.maximum(run[:, 2], 1)
            cut = np.stack([first[long], first[long + 1] - window + 1], axis=1).ravel()
            out[long, k] = np.maximum.reduceat(np.append(rate, -np.inf), cut)[::2]
    return out


def inputs(evidence: np.ndarray) -> np.ndarray:
    """What the logistic curve reads: 1, the difference for each symbol, the logarithm of the length, the largest differences in a stretch."""
    return np.column_stack([np.ones(len(evidence)), evidence[:, 1] - evidence[:, 0], np.log1p(evidence[:, 2]), evidence[:, 3:]])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Coefficients by Newton's steps on the weighted log loss with a small ridge."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    scale[0] = 1
    x, beta = x / scale, np.zeros(x.shape[1])
    weight = weight / weight.sum()
    ridge = penalty * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge @ beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(beta)), slope)
        beta = beta - step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return beta / scale


class Detector:
    """Models and curve. Without both classes to learn from, every text gets the share of toxic labels, at least 0.01 and at most 0.99."""

    def __init__(self, texts: list[bytes], toxic: np.ndarray, share: float):
        self.models, self.share = None, float(np.clip(share, 0.01, 0.99))
        if not (toxic.any() and (~toxic).any()):
            return
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
        low = LOWER[data]
        start, end, first = words_of(low, offsets, NO_LETTER)
        if not len(start):
            return
        whose = np.repeat(np.arange(len(texts)), np.diff(first))
        # words in parts, so that hashes don't need the whole sample's memory
        hashes = np.concatenate([Rolling(low[offsets[a] : offsets[b]]).of(start[first[a] : first[b]] - offsets[a], end[first[a] : first[b]] - offsets[a]) for a, b in pieces(offsets, PIECE)])
        names, one, word = np.unique(hashes, return_index=True, return_inverse=True)
        keys, symbols = grams(low, start[one], end[one])
        half = np.zeros(len(texts), np.int64)
        for c in (False, True):
            half[toxic == c] = np.arange((toxic == c).sum()) % 2

        def fitted(use: np.ndarray) -> Models:
            counts = np.stack([np.bincount(word[use[whose] & (toxic[whose] == c)], None, len(one)) for c in (False, True)], axis=1)
            some = counts.sum(axis=1) > 0
            return Models(names[some], counts[some].astype(float), keys[np.repeat(some, symbols)], symbols[some])

        # the curve is fitted to texts that the models haven't seen
        seen = np.zeros((len(texts), 3 + len(WINDOWS)))
        for k in (0, 1):
            seen[half == k] = Reader(fitted(half != k)).evidence(*_joined([x for x, h in zip(texts, half, strict=True) if h == k]))
        weight = np.where(toxic, MISSED * self.share / toxic.sum(), (1 - self.share) / (~toxic).sum())
        self.curve = logistic(inputs(seen), toxic.astype(float), weight)
        self.models = fitted(np.ones(len(texts), bool))

    def reader(self):
        return Reader(self.models) if self.models else None

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs(evidence) @ self.curve, -30, 30)))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)


def learned(docs: DataFrame, labels: DataFrame) -> Detector:
    """A detector from the labelled texts outside fold 0 (crc32 of the id's text, modulo 5): of each class a bounded sample by hash of the id.

    Rows with null ids or labels teach nothing; of several labels of an id the largest counts; repeated rows of an id,
    and texts over FIT_BYTES, are left out of the sample.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(id_crc() % 5 != 0).withColumn("toxic", F.col("toxic") > 0)
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    some = lambda c: known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    chosen = some(True).unionByName(some(False))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") <= FIT_BYTES)
    # a second row of an id is dropped here, before it reaches the driver
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    whole = sum(sizes.values())
    return Detector([r["text"].encode() for r in rows], np.array([r["toxic"] for r in rows], bool), sizes.get(True, 0) / whole if whole else 0.0)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, plain_rate and toxic_rate (both models' log10 likelihood for each symbol) for each row of docs, repeated ones included.

    Only the text makes a score; other columns are ignored. Null texts and those without letters get the score of an
    empty text, and rates of 0. A null doc_id counts as the empty text for the fold, so it is held out. An empty table
    gives no rows. Fitting runs while the plan is built, on a bounded sample.
    """
    spark = docs.sparkSession
    detector = learned(docs, labels)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(detector)

    def run(batches):
        own = shared.value
        reader = own.reader()
        for batch in batches:
            found = reader.evidence(*text_bytes(batch.column("text"))) if reader else np.zeros((len(batch), 2))
            score = own.score(found) if reader else np.full(len(batch), own.share)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *(pa.array(x) for x in (score, found[:, 0] / np.log(10), found[:, 1] / np.log(10)))], ["doc_id", "held_out", "score", "plain_rate", "toxic_rate"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_crc() % 5 == 0).alias("held_out"), "text")
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double, plain_rate double, toxic_rate double")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "plain_rate", "toxic_rate")
