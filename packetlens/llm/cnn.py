"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. Bytes are embedded, learned filters
run over each chunk, each filter is max-pooled over its chunk, a small hidden layer turns the pooled values into a
chunk's logit, and the logits, weighted by the bytes of their chunks, are averaged into one probability.

Scoring is an Arrow function over all documents, one bounded slice at a time; the model is a few kilobytes and
travels with it. Fitting uses a bounded sample of the labelled rows (``Training``: at most ``per_class`` documents of each
label, of at most ``max_bytes`` each), chosen by a hash of the id, so it doesn't depend on partitions or row order.

Defined results: null and empty texts are one chunk of padding and get a score. Labels are learned from rows
whose id isn't null; of conflicting labels the lower counts, null labels are ignored. Repeated rows are scored one by one. With
labels of one kind only, or none, every score is the share of good labels (0.5 without any). An empty table
gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlens.llm.common import stored, table

CHUNK = 512
OVERLAP = 64
STRIDE = 4
WIDTH = 8
EMBED = 8
FILTERS = 32
HIDDEN = 16
#: Chunks that are computed at one time.
BLOCK_CHUNKS = 1024
THRESHOLD = 0.3
HELD_OUT = 5


@dataclass(frozen=True)
class Training:
    """The bounds of the training sample, and how it is fitted."""

    per_class: int = 1500
    max_bytes: int = 32_768
    epochs: int = 10
    batch: int = 32
    rate: float = 0.004
    seed: int = 11


def chunks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunks, document of each, weight of each): overlapping pieces of every text, the last padded with zeros."""
    step = CHUNK - OVERLAP
    counts = np.array([max(1, -(-(len(t) - OVERLAP) // step)) for t in texts], "i8")
    out = np.zeros((int(counts.sum()), CHUNK), "u1")
    weight, at = np.empty(len(out), "f4"), 0
    for text, n in zip(texts, counts):
        data = np.frombuffer(text, "u1")
        for k in range(n):
            piece = data[k * step : k * step + CHUNK]
            out[at, : len(piece)] = piece
            weight[at] = max(1, len(piece))
            at += 1
    return out, np.repeat(np.arange(len(texts)), counts), weight


class Network:
    """Parameters: byte embedding, filters and their bias, hidden layer, output, and the prior of constant models."""

    NAMES = ("embed", "filters", "bias", "hidden", "hidden_bias", "out", "out_bias")

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (256, EMBED)).astype("f4")
        self.filters = r.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH * EMBED, FILTERS)).astype("f4")
        self.bias = np.zeros(FILTERS, "f4")
        self.hidden = r.normal(0, 1 / np.sqrt(FILTERS), (FILTERS, HIDDEN)).astype("f4")
        self.hidden_bias = np.zeros(HIDDEN, "f4")
        self.out = r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN).astype("f4")
        self.out_bias = np.zeros(1, "f4")
        self.constant: float | None = None

    def responses(self, chunks: np.ndarray) -> np.ndarray:
        """(chunk, place, filter): filters of WIDTH bytes at every STRIDE bytes.

        A filter is two halves of STRIDE bytes, so both are plain products over the bytes laid out by four.
        """
        half = STRIDE * EMBED
        x = self.embed[chunks].reshape(len(chunks), CHUNK // STRIDE, half)
        first, second = x @ self.filters[:half], x @ self.filters[half:]
        return first[:, :-1] + second[:, 1:]

    def chunk_logits(self, pooled: np.ndarray) -> np.ndarray:
        hidden = np.maximum(pooled @ self.hidden + self.hidden_bias, 0)
        return hidden @ self.out + self.out_bias

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        return np.maximum(self.responses(chunks).max(1) + self.bias, 0)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        total, weights = np.zeros(len(texts)), np.zeros(len(texts))
        for part, docs in _bounded(texts):
            chunks, doc, weight = part
            logits = self.chunk_logits(self.pooled(chunks))
            total += np.bincount(doc + docs, weight * logits, len(texts))
            weights += np.bincount(doc + docs, weight, len(texts))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(weights, 1), -40, 40)))

    def gradients(self, chunks, doc, weight, labels, importance) -> dict[str, np.ndarray]:
        """Of the weighted cross entropy of whole documents."""
        n = len(labels)
        raw = self.responses(chunks)
        place = raw.argmax(1)
        pooled = np.take_along_axis(raw, place[:, None, :], 1)[:, 0] + self.bias
        active = np.maximum(pooled, 0)
        before = active @ self.hidden + self.hidden_bias
        hidden = np.maximum(before, 0)
        share = weight / np.bincount(doc, weight, n)[doc]
        logits = np.bincount(doc, share * (hidden @ self.out + self.out_bias), n)
        error = (1 / (1 + np.exp(-logits)) - labels) * importance / n
        d_chunk = (error[doc] * share).astype("f4")
        d_hidden = np.outer(d_chunk, self.out) * (before > 0)
        d_pooled = (d_hidden @ self.hidden.T) * (pooled > 0)
        # Only the bytes under each filter's maximum have a gradient.
        at = place[:, :, None] * STRIDE + np.arange(WIDTH)
        seen = chunks[np.arange(len(chunks))[:, None, None], at]
        x = self.embed[seen].reshape(len(chunks), FILTERS, WIDTH * EMBED)
        d_x = (d_pooled[:, :, None] * self.filters.T[None]).reshape(-1, EMBED)
        flat = seen.ravel()
        return {
            "embed": np.stack([np.bincount(flat, d_x[:, k], 256) for k in range(EMBED)], 1),
            "filters": np.einsum("cf,cfk->kf", d_pooled, x, optimize=True),
            "bias": d_pooled.sum(0),
            "hidden": active.T @ d_hidden,
            "hidden_bias": d_hidden.sum(0),
            "out": hidden.T @ d_chunk,
            "out_bias": d_chunk.sum(keepdims=True),
        }


def _bounded(texts: list[bytes]):
    """Chunks of the texts in blocks of bounded size; a long text is cut where chunks are cut anyway."""
    step, size = CHUNK - OVERLAP, BLOCK_CHUNKS * (CHUNK - OVERLAP)
    held: list[bytes] = []
    first, room = 0, size
    for i, text in enumerate(texts):
        if len(text) > room and held:
            yield chunks_of(held), first
            held, first, room = [], i, size
        if len(text) > size:
            # Each part ends with the overlap of the next, so the chunks are those of the whole text.
            last = len(text) - OVERLAP
            for at in range(0, last, size):
                yield chunks_of([text[at : at + size + OVERLAP]]), i
            first = i + 1
            continue
        held.append(text)
        room -= max(step, len(text))
    if held:
        yield chunks_of(held), first


def fit(texts: list[bytes], labels: list[int], training: Training = Training()) -> Network:
    """Adam on batches of whole documents; both labels weigh the same in total."""
    net = Network(training.seed)
    y = np.array(labels, "f8")
    if not len(y) or y.min() == y.max():
        net.constant = float(y.mean()) if len(y) else 0.5
        return net
    importance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    r = np.random.default_rng(training.seed)
    first = {k: np.zeros_like(getattr(net, k)) for k in net.NAMES}
    second = {k: np.zeros_like(getattr(net, k)) for k in net.NAMES}
    steps = training.epochs * -(-len(y) // training.batch)
    t = 0
    for _ in range(training.epochs):
        order = r.permutation(len(y))
        for at in range(0, len(y), training.batch):
            own = order[at : at + training.batch]
            g = net.gradients(*chunks_of([texts[i] for i in own]), y[own], importance[own])
            t += 1
            rate = training.rate * (1 - t / (steps + 1))
            for k, v in g.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                move = rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
                setattr(net, k, (getattr(net, k) - move).astype("f4"))
    return net


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD_OUT == 0


def sample(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> tuple[list[bytes], list[int]]:
    """The training documents: never held-out ones; at most 2 * ``per_class`` reach the driver."""
    own = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    one = own.groupBy("doc_id").agg(F.min("quality").alias("label"))
    order = [F.xxhash64(F.lit(training.seed), "doc_id"), F.col("doc_id")]
    chosen = None
    for label in (0, 1):
        part = one.filter(F.col("label") == label).orderBy(*order).limit(training.per_class)
        chosen = part if chosen is None else chosen.unionAll(part)
    # Bounded by the limits above, so it may be broadcast.
    chosen = F.broadcast(stored(chosen, "training-ids"))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", text.alias("text")).filter(F.octet_length("text") <= training.max_bytes).join(chosen, "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).orderBy("doc_id").collect()
    return [bytes(r["text"]) for r in rows], [r["label"] for r in rows]


def with_score(docs: DataFrame, net: Network, name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 from ``text`` alone."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), 256):
            out.append(net.score([(t.as_py() or "").encode("utf-8", "surrogatepass") for t in texts.slice(at, 256)]))
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    return docs.withColumn(name, F.arrow_udf(run, "double").asNondeterministic()(F.col("text")))


def train(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> Network:
    return fit(*sample(docs, labels, training), training)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = train(docs, table(spark, sf_dir, "labels"))
    return with_score(docs, net).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
