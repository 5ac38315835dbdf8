"""Quality scores from a byte-level convolutional network in numpy.

A text is laid out in blocks of 16 bytes; a chunk is two neighbouring blocks, so chunks overlap by half and cover the
whole text. Each byte becomes a learned vector, learned filters respond to a chunk's 32 vectors, and each filter's
largest response over all chunks is kept. A logistic unit combines the pooled responses into one probability. Memory
follows the size of a piece of text, and results don't depend on how texts are batched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_crc, pieces, small_batches, text_bytes

BLOCK, CHUNK, VECTOR, FILTERS = 16, 32, 8, 32
#: The model is fitted on so many labelled texts at most, of so many bytes at most each; texts to score have no bound.
FIT_ROWS, FIT_BYTES = 3000, 1 << 16
EPOCHS, BATCH, RATE, DECAY = 14, 32, 0.004, 1e-4
#: Score from which a text counts as good.
GOOD = 0.3
#: Bytes that are worked on at once; blocks that go through the filters at once.
PIECE, BLOCKS = 1 << 21, 1 << 13


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.vectors = (r.standard_normal((256, VECTOR)) * 0.5).astype(np.float32)
        self.vectors[0] = 0
        self.filters = (r.standard_normal((CHUNK * VECTOR, FILTERS)) * 0.08).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = np.zeros(FILTERS, np.float32)
        self.out_bias = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.bias, self.out, self.out_bias]


def laid_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of all texts with an empty block after each text, each text's first block, and its number of blocks."""
    sizes = np.diff(offsets)
    many = -(-sizes // BLOCK)
    first = np.concatenate(([0], np.cumsum(many + 1)))
    out = np.zeros(int(first[-1]) * BLOCK, np.uint8)
    out[np.arange(len(data)) + np.repeat(first[:-1] * BLOCK - offsets[:-1], sizes)] = data
    return out.reshape(-1, BLOCK), first[:-1], many


def _pool(values: np.ndarray, first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The largest value over each text's chunks; 0 for texts without any."""
    out = np.zeros((len(first), *values.shape[1:]), values.dtype)
    some = np.flatnonzero(many > 0)
    if len(some):
        cut = np.stack([first[some], first[some] + many[some]], axis=1).ravel()
        out[some] = np.maximum.reduceat(np.concatenate([values, values[-1:]]), cut, axis=0)[::2]
    return out


def responses(blocks: np.ndarray, network: Network) -> np.ndarray:
    """The filters' responses to the chunk that begins at each block."""
    half = BLOCK * VECTOR
    both = np.concatenate([network.filters[:half], network.filters[half:]], axis=1)
    own = np.empty((len(blocks), 2 * FILTERS), np.float32)
    for i in range(0, len(blocks), BLOCKS):
        own[i : i + BLOCKS] = network.vectors[blocks[i : i + BLOCKS]].reshape(-1, half) @ both
    out = own[:, :FILTERS] + network.bias
    out[:-1] += own[1:, FILTERS:]
    return out


def features(data: np.ndarray, offsets: np.ndarray, network: Network) -> np.ndarray:
    blocks, first, many = laid_out(data, offsets)
    if not len(blocks):
        return np.zeros((len(first), FILTERS), np.float32)
    # a text's last block is the second half of a chunk, unless it is the only one
    return np.maximum(_pool(responses(blocks, network), first, np.where(many > 1, many - 1, many)), 0)


def score(data: np.ndarray, offsets: np.ndarray, network: Network) -> np.ndarray:
    """Probability that each text is good. Longer texts than two pieces are worked on in parts that overlap, so that every chunk of the whole is in one."""
    out = np.zeros(len(offsets) - 1)
    for at, to in pieces(offsets, PIECE):
        if offsets[to] - offsets[at] > 2 * PIECE:
            lo, hi = int(offsets[at]), int(offsets[to])
            x = np.zeros((1, FILTERS), np.float32)
            for i in range(lo, hi, PIECE):
                j = min(i + PIECE + BLOCK, hi)
                x = np.maximum(x, features(data[i:j], np.array([0, j - i]), network))
        else:
            x = features(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], network)
        out[at:to] = 1 / (1 + np.exp(-(x @ network.out + network.out_bias[0]).astype(np.float64)))
    return out


def gradients(texts: list[bytes], good: np.ndarray, network: Network) -> list[np.ndarray]:
    """The mean log loss's gradient by each of the network's parameters; that of a pooled response goes to the chunk that won."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    blocks, first, many = laid_out(data, np.concatenate(([0], np.cumsum([len(x) for x in texts]))))
    z = responses(blocks, network)
    chunks = np.where(many > 1, many - 1, many)
    won = np.stack([z[a : a + m].argmax(axis=0) + a if m else np.zeros(FILTERS, np.int64) for a, m in zip(first.tolist(), chunks.tolist(), strict=True)])
    pooled = np.where(chunks[:, None] > 0, z[won, np.arange(FILTERS)], 0)
    x = np.maximum(pooled, 0)
    p = 1 / (1 + np.exp(-(x @ network.out + network.out_bias[0])))
    error = ((p - good) / len(texts)).astype(np.float32)
    back = error[:, None] * network.out[None] * (pooled > 0)
    seen = np.concatenate([blocks[won], blocks[np.minimum(won + 1, len(blocks) - 1)]], axis=2).reshape(len(texts) * FILTERS, CHUNK)
    inputs = network.vectors[seen].reshape(len(texts), FILTERS, CHUNK * VECTOR)
    to_filters = np.einsum("bf,bfk->kf", back, inputs)
    to_inputs = back.ravel()[:, None] * np.tile(network.filters.T, (len(texts), 1))
    to_vectors = np.zeros_like(network.vectors)
    for v in range(VECTOR):
        to_vectors[:, v] = np.bincount(seen.ravel(), to_inputs[:, v::VECTOR].ravel(), 256)
    to_vectors[0] = 0
    return [to_vectors, to_filters, back.sum(axis=0), x.T @ error, error.sum(keepdims=True)]


def fit(texts: list[bytes], good: np.ndarray, seed: int = 7) -> Network:
    """A network fitted to labelled texts by Adam, with decaying steps and weight decay on the filters."""
    network = Network(seed)
    if not len(texts):
        return network
    r = np.random.default_rng(seed)
    rate = np.clip(good.mean(), 0.01, 0.99)
    network.out_bias[0] = np.log(rate / (1 - rate))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in network.parameters()]
    step = 0
    for epoch in range(EPOCHS):
        order = r.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            if not any(len(texts[k]) for k in own):
                continue
            grads = gradients([texts[k] for k in own], good[own], network)
            grads[1] = grads[1] + DECAY * network.filters
            step += 1
            for value, (m, s), g in zip(network.parameters(), moments, grads, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                value -= RATE * (1 - epoch / EPOCHS) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return network


def learned(docs: DataFrame, labels: DataFrame) -> Network:
    """A network from the labelled texts outside fold 0 (crc32 of the id's text, modulo 5): a bounded sample by hash of the id.

    Rows with null ids or labels teach nothing; of several labels of an id the least counts; repeated rows of an id,
    and texts over FIT_BYTES, are left out of the sample. Nothing to learn from gives a network with one answer.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    chosen = known.where(id_crc() % 5 != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") <= FIT_BYTES)
    rows = texts.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "text").limit(FIT_ROWS).collect()
    one = {r["doc_id"]: r for r in reversed(rows)}
    rows = [one[k] for k in sorted(one)]
    return fit([r["text"].encode() for r in rows], np.array([float(r["quality"] > 0) for r in rows], np.float32))


def with_scores(docs: DataFrame, network: Network, column: str = "score", text: bool = True) -> DataFrame:
    """docs, with or without its text, with one more column: the probability that text is good. Null and empty texts get that of an empty text."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(network)

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(score(data, offsets, shared.value))], [*kept, column])

    kept = [c for c in docs.columns if text or c != "text"]
    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + f", `{column}` double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs, repeated ones included.

    Only the text makes a score; other columns are ignored. A null doc_id counts as the empty text for the fold, so
    it is held out. An empty table gives no rows.
    """
    network = learned(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_crc() % 5 == 0).alias("held_out"), "text")
    return with_scores(rows, network, text=False).select("doc_id", "held_out", "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that count as good, columns as they came."""
    return with_scores(docs, learned(docs, labels), "quality_score").where(F.col("quality_score") >= GOOD).select(*docs.columns)
