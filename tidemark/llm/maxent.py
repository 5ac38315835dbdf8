"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

Words are numbered by how often they occur. P(word | history) is a product along three levels: the group of 1024 words
by number, the class of 32 in the group, the word in the class. A word beyond the numbered ones belongs to the tail
group that its last two bytes name, so that any word, seen or not, has a group. Each level is a log-linear softmax over
32 outcomes in hashed features of the history: for groups the previous word, the previous two, and the word before the
previous one (a skip); for classes and words the previous word. Within a tail group a word has its add-0.5 share of the
group's counts, with one place for all unseen words, so that the probabilities of all words sum to one.

Training runs in rounds, each over its own part of the texts. In a round every shard of texts takes adaptive gradient
steps from the same start; the shards' rows are then averaged by how often each shard met a row, and the average is
the start of the next round. Shards, and the order of texts in one, come from hashes of the texts: how the input is
partitioned has no part in the result. Shards grow with the tokens, table rows with their fourth root. Counts come from
a Spark aggregation; the table of counts stays distributed: a bounded head of it is broadcast, the rest is joined.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, Rolling, id_crc, materialize, pieces, small_batches, text_bytes, words_of

#: The end of a text as a token; no word holds a line break.
END = b"\n"
#: Words that are broadcast with their counts, at most, and their longest; outcomes of a softmax; groups of numbered words; tail groups.
HEAD, LONGEST, WIDE, GROUPS, TAILS = 1 << 17, 64, 32, 16, 16
#: Words with a number of their own in the model.
MODELLED = GROUPS * WIDE * WIDE
#: Rounds of training; shards and table rows for so many tokens; the fewest shards and the most rows of a table.
ROUNDS, SHARDS, ROWS, TOKENS, LEAST_SHARDS, MOST_ROWS = 3, 12, 1 << 14, 1 << 26, 6, 1 << 18
#: Tokens of one update; its first step; the added weight in the adaptive step.
STEP_TOKENS, STEP, EPS = 1 << 14, 0.15, 1e-3
#: Bytes of text that are counted, or worked on, at once.
COUNTED, PIECE = 1 << 24, 1 << 20


def shards_of(tokens: int) -> int:
    return max(LEAST_SHARDS, round(SHARDS * tokens / TOKENS))


def rows_of(tokens: int) -> int:
    """Rows of each table, in parts of 64."""
    return min(max(int(ROWS / 64 * (tokens / TOKENS) ** 0.25), 16) * 64, MOST_ROWS)


#: The tail class of every pair of last bytes; a word of one byte counts as if a zero byte stood before it.
TAIL_OF = np.array([zlib.crc32(bytes(divmod(k, 256))) % TAILS for k in range(1 << 16)], np.int64)


def tail_class(word: bytes) -> int:
    return int(TAIL_OF[int.from_bytes(word[-2:], "big")])


def hash_of(words: list[bytes]) -> np.ndarray:
    """The 64-bit hashes of words, as Stream finds them in a text."""
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return Rolling(np.frombuffer(b"".join(words), np.uint8)).of(np.concatenate(([0], ends[:-1])), ends) if words else np.zeros(0, np.uint64)


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, int]:
    """The batch's words end to end, their sizes, and a count of one end for each text."""
    data, offsets = text_bytes(batch.column("text"))
    data = LOWER[data]
    start, end, _ = words_of(data, offsets)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] += 1
    np.subtract.at(inside, end, 1)
    return data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)], end - start, batch.num_rows


def _count(batches):
    """Partial counts of words in the texts to learn from (c) and in all (every)."""
    held, size = ([], []), 0
    for batch in batches:
        out = np.array(batch.column("held_out"), bool)
        for side, own in enumerate((batch.filter(pa.array(~out)), batch.filter(pa.array(out)))):
            if own.num_rows:
                held[side].append(_words(own))
                size += len(held[side][-1][0])
        if size >= COUNTED:
            yield from _counted(held)
            held, size = ([], []), 0
    yield from _counted(held)


def _counted(held):
    for side, parts in enumerate(held):
        if not parts:
            continue
        sizes = np.concatenate([x[1] for x in parts])
        offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        data = np.concatenate([x[0] for x in parts])
        found = pc.value_counts(pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)]))
        for words, many in ((found.field("values").cast(pa.binary()), found.field("counts").cast(pa.int64())), (pa.array([END], pa.binary()), pa.array([sum(x[2] for x in parts)], pa.int64()))):
            yield pa.RecordBatch.from_arrays([words, pc.multiply(many, 1 - side), many], ["word", "c", "every"])


class Vocabulary:
    """What every task knows of the words: the head's order and counts, and the totals of the tail classes."""

    def __init__(self, head: list[tuple[bytes, int]], tokens: int, distinct: int, tail_tokens: np.ndarray, tail_words: np.ndarray):
        head = sorted(head, key=lambda x: (-x[1], x[0]))
        hashes = hash_of([w for w, _ in head])
        order = np.argsort(hashes)
        self.hashes, self.codes = np.append(hashes[order], np.uint64(2**64 - 1)), np.append(order, -1)
        # where the hashes that begin with some 18 bits start
        self.index = np.searchsorted(self.hashes, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46)).astype(np.int64)
        self.end = next((i for i, (w, _) in enumerate(head) if w == END), -1)
        self.count = np.array([c for _, c in head], np.int64)
        self.modelled = min(MODELLED, int((self.count > 0).sum()))
        self.tokens, self.distinct = tokens, distinct
        self.log_tail = np.log10(np.maximum(tail_tokens + 0.5 * (tail_words + 1), 0.5))
        self.base_log = float(np.log10(tokens + 0.5 * (distinct + 1)))

    def codes_of(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words in the head's order by their hashes; -1 for words outside."""
        at = self.index[(hashes >> np.uint64(46)).astype(np.int64)]
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        while len(left):
            found = self.hashes[at]
            hit = found == hashes[left]
            out[left[hit]] = self.codes[at[hit]]
            more = found < hashes[left]
            left, at = left[more], at[more] + 1
        return out


class Model:
    """Weights and biases of the three levels: groups, classes in a group, words in a class; and what the squared steps of each table's rows have added up to."""

    def __init__(self, vocabulary: Vocabulary, tail_tokens: np.ndarray):
        counts = np.zeros(MODELLED)
        counts[: vocabulary.modelled] = vocabulary.count[: vocabulary.modelled]
        words = counts.reshape(-1, WIDE)
        classes = words.sum(axis=1).reshape(-1, WIDE)
        groups = np.concatenate([classes.sum(axis=1), tail_tokens])
        # without anything in it a numbered group, class or word can't be drawn
        with np.errstate(divide="ignore"):
            self.bias = [np.log(np.where(np.arange(len(groups)) < GROUPS, groups, groups + 0.5))[None].astype(np.float32), np.log(classes).astype(np.float32), np.log(words).astype(np.float32)]
        for bias in self.bias[1:]:
            bias[np.isneginf(bias).all(axis=1)] = 0
        rows = rows_of(vocabulary.tokens)
        self.tables = [np.zeros((rows, WIDE), np.float32) for _ in self.bias]
        self.past = [np.zeros(rows, np.float32) for _ in self.bias]


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def _hashed(parts: list[np.ndarray], salt: int, rows: int) -> np.ndarray:
    h = np.full(len(parts[0]), salt, np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.int64) % rows


class Stream:
    """The tokens of some texts (bytes end to end) as numbers, with the outcome, features and bias of each level."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary, rows: int):
        self.data = data = LOWER[data]
        start, end, first = words_of(data, offsets)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        n = len(start) + len(offsets) - 1
        at = np.arange(len(start)) + owner
        self.sizes = np.diff(first) + 1
        self.code = np.full(n, vocabulary.end, np.int64)
        hashes = Rolling(data).of(start, end)
        self.code[at] = vocabulary.codes_of(hashes)
        tail = np.full(n, tail_class(END), np.int64)
        before = np.where(end - start > 1, data[np.maximum(end - 2, 0)], 0).astype(np.int64)
        tail[at] = TAIL_OF[before * 256 + data[end - 1]]
        #: Tokens outside the head, where their bytes lie, and their hashes; the end is among them only if it was never seen.
        place = np.full((2, n), -1, np.int64)
        place[:, at] = start, end
        self.unknown = np.flatnonzero(self.code < 0)
        self.place = place[:, self.unknown]
        every = np.zeros(n, np.uint64)
        every[at] = hashes
        self.hash = every[self.unknown]
        self.modelled = (self.code >= 0) & (self.code < vocabulary.modelled)
        self.tail = tail
        symbol = np.where(self.code >= 0, self.code, HEAD + tail)
        spot = np.arange(n) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        back = []
        for k in (1, 2):
            s = np.full(n, HEAD + TAILS, np.int64)
            s[k:] = symbol[: n - k]
            s[spot < k] = HEAD + TAILS
            back.append(s)
        history = ([back[0]], [back[1], back[0]], [back[1]])
        inside = np.flatnonzero(self.modelled)
        code, last = self.code[inside], back[0][inside]
        group, cls = code // (WIDE * WIDE), code // WIDE
        #: Of each level: its tokens, their features' rows, their bias row, and their outcome.
        self.levels = [
            (np.arange(n), np.stack([_hashed(p, k + 1, rows) for k, p in enumerate(history)]), np.zeros(n, np.int64), np.where(self.modelled, self.code // (WIDE * WIDE), GROUPS + tail)),
            (inside, _hashed([group, last], 11, rows)[None], group, cls % WIDE),
            (inside, _hashed([cls, last], 12, rows)[None], cls, code % WIDE),
        ]


def _energy(table: np.ndarray, bias: np.ndarray, rows: np.ndarray, where: np.ndarray) -> np.ndarray:
    x = np.take(table, rows[0], axis=0)
    for own in rows[1:]:
        x += np.take(table, own, axis=0)
    x += bias if len(bias) == 1 else np.take(bias, where, axis=0)
    return x


def log_probabilities(stream: Stream, model: Model) -> np.ndarray:
    """log10 of each token's group, and for the numbered words of the class and the word as well."""
    out = np.zeros(len(stream.code))
    for (tokens, features, where, own), table, bias in zip(stream.levels, model.tables, model.bias, strict=True):
        for i in range(0, len(tokens), STEP_TOKENS):
            part = slice(i, i + STEP_TOKENS)
            x = _energy(table, bias, features[:, part], where[part])
            x -= x.max(axis=1, keepdims=True)
            mine = x[np.arange(len(x)), own[part]].copy()
            out[tokens[part]] += mine - np.log(np.exp(x, out=x).sum(axis=1))
    return out / np.log(10)


def _update(table: np.ndarray, past: np.ndarray, seen: np.ndarray, rows: np.ndarray, error: np.ndarray) -> None:
    """One adaptive step on the rows that features name; error is the gradient of each token's loss."""
    kind = np.uint16 if len(table) <= 1 << 16 else np.uint32
    for own in rows:
        order = np.argsort(own.astype(kind), kind="stable")
        key = own[order]
        cut = np.flatnonzero(np.diff(key, prepend=-1))
        key = key[cut]
        gradient = np.add.reduceat(np.take(error, order, axis=0), cut, axis=0)
        past[key] += np.einsum("ij,ij->i", gradient, gradient) / WIDE
        gradient *= (STEP / (np.sqrt(past[key]) + EPS))[:, None]
        table[key] -= gradient
        seen[key] += np.diff(cut, append=len(order))


def train(texts, vocabulary: Vocabulary, model: Model) -> list[np.ndarray]:
    """Updates the model's tables in place from (bytes, offsets) of texts; how often each of their rows was met."""
    seen = [np.zeros(len(t)) for t in model.tables]
    for data, offsets in texts:
        stream = Stream(data, offsets, vocabulary, len(model.tables[0]))
        for i in range(0, len(stream.code), STEP_TOKENS):
            for (tokens, features, where, own), table, past, bias, many in zip(stream.levels, model.tables, model.past, model.bias, seen, strict=True):
                a, b = np.searchsorted(tokens, (i, i + STEP_TOKENS))
                if a < b:
                    p = _softmax(_energy(table, bias, features[:, a:b], where[a:b]))
                    p[np.arange(b - a), own[a:b]] -= 1
                    _update(table, past, many, features[:, a:b], p)
    return seen


#: Parts into which the tables are cut for the averaging.
PARTS = 64


def _by_shard(batches):
    """(shard, its texts as (bytes, offsets) of about PIECE bytes): cut by what the shard holds, not by how it comes in batches."""
    held, size, now = [], 0, None

    def flush():
        return np.concatenate([d for d, _ in held]), np.concatenate(([0], np.cumsum(np.concatenate([n for _, n in held]))))

    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        shard = np.array(batch.column("shard"))
        ends = np.append(np.flatnonzero(np.diff(shard)) + 1, len(shard)) if len(shard) else []
        i = 0
        for j in ends:
            if now is not None and shard[i] != now and held:
                yield now, flush()
                held, size = [], 0
            now = int(shard[i])
            while i < j:
                k = min(int(np.searchsorted(offsets[i + 1 : j + 1], offsets[i] + PIECE - size)) + i + 1, j)
                held.append((data[offsets[i] : offsets[k]], np.diff(offsets[i : k + 1])))
                size += int(offsets[k] - offsets[i])
                i = int(k)
                if size >= PIECE:
                    yield now, flush()
                    held, size = [], 0
    if held:
        yield now, flush()


_PARTS_SCHEMA = "which int, part int, shard int, weighted binary, seen binary"


def _trainer(shared):
    def run(batches):
        vocabulary, model = shared.value
        for shard, texts in itertools.groupby(_by_shard(batches), key=lambda x: x[0]):
            own = Model.__new__(Model)
            own.bias, own.tables, own.past = model.bias, [t.copy() for t in model.tables], [t.copy() for t in model.past]
            seen = train((x for _, x in texts), vocabulary, own)
            rows = []
            for which, (table, past, n) in enumerate(zip(own.tables, own.past, seen, strict=True)):
                weighted = np.concatenate([table, past[:, None]], axis=1) * n[:, None]
                rows += [(which, k, w.astype(np.float32).tobytes(), m.tobytes()) for k, (w, m) in enumerate(zip(np.split(weighted, PARTS), np.split(n, PARTS), strict=True)) if m.any()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([shard] * len(rows), pa.int32()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())], ["which", "part", "shard", "weighted", "seen"])

    return run


def _summed(kind: type):
    def run(table: pa.Table) -> pa.Table:
        # in the order of shards, so that sums don't depend on arrival
        table = table.sort_by("shard")
        weighted = sum(np.frombuffer(x.as_buffer(), kind).astype(np.float64) for x in table.column("weighted"))
        seen = sum(np.frombuffer(x.as_buffer()) for x in table.column("seen"))
        return pa.table({"which": table.column("which")[:1], "part": table.column("part")[:1], "shard": table.column("shard")[:1], "weighted": pa.array([weighted.tobytes()], pa.binary()), "seen": pa.array([seen.tobytes()], pa.binary())})

    return run


def fit(texts: DataFrame, tail_tokens: np.ndarray, vocabulary: Vocabulary) -> Model:
    """A model of all the texts (columns doc_id and text). Its tables, of bounded size, pass through the driver once a round."""
    spark = texts.sparkSession
    model = Model(vocabulary, tail_tokens)
    shards = shards_of(vocabulary.tokens)
    order = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    dealt = texts.select("text", order.alias("order")).select("text", "order", F.pmod(F.xxhash64("order"), F.lit(ROUNDS)).alias("round"), F.pmod(F.shiftright("order", 20), F.lit(shards)).cast("int").alias("shard"))
    folds = max(1, int(shards**0.5))
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast((vocabulary, model))
        own = dealt.where(F.col("round") == k).drop("round").repartition(shards, "shard").sortWithinPartitions("shard", "order", "text").select("shard", "text")
        parts = own.mapInArrow(_trainer(shared), _PARTS_SCHEMA)
        # in two levels: a task sums about as many shards as there are folds
        parts = parts.groupBy("which", "part", (F.col("shard") % folds).alias("fold")).applyInArrow(_summed(np.float32), _PARTS_SCHEMA)
        for row in parts.groupBy("which", "part").applyInArrow(_summed(np.float64), _PARTS_SCHEMA).toLocalIterator():
            table, past = model.tables[row["which"]], model.past[row["which"]]
            size = len(table) // PARTS
            seen = np.frombuffer(row["seen"])[:, None]
            rows = slice(row["part"] * size, (row["part"] + 1) * size)
            mean = np.frombuffer(row["weighted"]).reshape(size, -1) / np.maximum(seen, 1)
            table[rows] = np.where(seen > 0, mean[:, :WIDE], table[rows])
            past[rows] = np.where(seen[:, 0] > 0, mean[:, WIDE], past[rows])
        shared.unpersist()
    return model


_SCORED = "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base double, score double, tail array<struct<word:binary,n:long>>"


def _scorer(shared):
    """Per text all that the head settles, and the words of the tail with how often each occurs."""

    def run(batches):
        vocabulary, model = shared.value
        row = TaskContext.get().partitionId() << 33
        kept = np.log10(vocabulary.count + 0.5)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for at, to in pieces(offsets, PIECE):
                stream = Stream(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], vocabulary, len(model.tables[0]))
                p = log_probabilities(stream, model)
                inside = stream.code >= 0
                log_count = np.zeros(len(p))
                log_count[inside] = kept[stream.code[inside]]
                known = np.zeros(len(p), np.int64)
                known[inside] = vocabulary.count[stream.code[inside]] > 0
                outside = ~stream.modelled
                p[outside] += log_count[outside] - vocabulary.log_tail[stream.tail[outside]]
                first = np.cumsum(stream.sizes) - stream.sizes
                # each text's words outside the head, once each
                owner = np.searchsorted(first, stream.unknown, side="right") - 1
                order = np.lexsort((stream.hash, owner))
                owner, hashes = owner[order], stream.hash[order]
                cut = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])))) if len(order) else order
                low = stream.data.tobytes()
                words = [low[i:j] if i >= 0 else END for i, j in stream.place[:, order[cut]].T.tolist()]
                once = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(np.diff(cut, append=len(order)), pa.int64())], ["word", "n"])
                tails = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[cut], np.arange(to - at + 1)), pa.int32()), once)
                n = to - at
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("held_out"),
                        pa.array(np.arange(row, row + n)),
                        pa.array(stream.sizes),
                        pa.array(np.add.reduceat(known, first)),
                        pa.array(np.add.reduceat(log_count, first) - stream.sizes * vocabulary.base_log),
                        pa.array(np.add.reduceat(p, first)),
                        tails,
                    ],
                    ["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "score", "tail"],
                )
                row += n

    return run


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs.

    docs needs doc_id and text; other columns are ignored. A null or empty text is its end alone. A null doc_id counts
    as an empty one for the fold, so it is learned from. Repeated rows are learned from and scored as often as they
    come. Without anything to learn from every token has the same one probability, 1, of the unseen; an empty table
    gives no rows. Words outside the broadcast head, or longer than its bound, are joined: those within the bound never
    stand for more than 1/HEAD of all tokens each. The model is fitted, and texts scored, while the plan is built.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (id_crc() % 5 == 1).alias("held_out"))
    counts = docs.select("text", "held_out").mapInArrow(_count, "word binary, c long, every long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("every").alias("every"))
    counts = materialize(counts, "counts")
    total = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    tokens, distinct = total[0] or 0, total[1]
    # the least count of a head of HEAD words at most; there are at most sqrt(2 * tokens) different counts
    short = F.octet_length("word") <= LONGEST
    least, held = None, 0
    for row in counts.where(short).groupBy("every").count().orderBy(F.desc("every")).toLocalIterator():
        if held + row["count"] > HEAD:
            break
        least, held = row["every"], held + row["count"]
    in_head = short & (F.col("every") >= least) if least else F.lit(False)
    head = [(bytes(r["word"]), r["c"]) for r in counts.where(in_head).select("word", "c").collect()]
    by_tail = np.zeros((2, TAILS), np.int64)
    # one row for each pair of last bytes at most
    last = F.expr("substring(word, greatest(octet_length(word) - 1, 1), 2)")
    for row in counts.where("c > 0").groupBy(last.alias("last")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        by_tail[:, tail_class(bytes(row["last"]))] += row["c"], row["v"]
    for w, c in sorted(head, key=lambda x: (-x[1], x[0]))[:MODELLED]:
        if c:
            by_tail[:, tail_class(w)] -= c, 1
    vocabulary = Vocabulary(head, tokens, distinct, *by_tail)
    model = fit(docs.where(~F.col("held_out")), by_tail[0], vocabulary)
    shared = spark.sparkContext.broadcast((vocabulary, model))
    first = materialize(docs.mapInArrow(_scorer(shared), _SCORED), "scored")
    rare = first.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.n")
    # what a word adds is counted once for each text; held-out words that nothing was learned of have no row to meet
    rest = counts.where(~in_head & (F.col("c") > 0)).select("word", "c")
    log_count = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    late = rare.join(rest, "word", "left").groupBy("row").agg(F.sum(log_count).alias("late"), F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("late_known"))
    both = first.drop("tail").join(late, "row", "left")
    late_log = F.coalesce("late", F.lit(0.0))
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("late_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + late_log).alias("base_score"),
        (F.col("score") + late_log).alias("score"),
    )
