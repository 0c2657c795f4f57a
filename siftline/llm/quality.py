"""Quality classifier: a byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes slide over the whole text, byte by byte.  Each filter's activation is max-pooled
over overlapping chunks of 2 x ``HALF`` bytes (each half belongs to two chunks), averaged over the chunks, and a logistic
unit combines the filters into one probability.  A filter over one-hot bytes is a table of 256 weights for each of its
places, so a convolution is WIDTH table look-ups a position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.runtime import Texts, trimmed

FILTERS, WIDTH, STRIDE, HALF = 16, 6, 1, 256
#: Labelled documents to learn from, at most (about; chosen by a hash of doc_id); passes over them; texts to a step.
SAMPLE_DOCS, EPOCHS, STEP_DOCS, RATE = 1500, 10, 32, 0.02
#: Bytes of a text to learn from, at most (longer ones are left out of the sample, and scored whole as all are).
SAMPLE_BYTES = 1 << 18
#: Bytes scored at once; a longer text is scored in pieces, and only its chunks' maxima are kept.
PIECE = 1 << 17


class Network:
    def __init__(self, tables: np.ndarray, bias: np.ndarray, weights: np.ndarray, offset: float):
        self.tables, self.bias, self.weights, self.offset = tables, bias, weights, offset

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), 0.0)

    def activations(self, data: np.ndarray) -> np.ndarray:
        """Positions x filters; the text is padded by zeros to hold one position at least."""
        data = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
        n = (len(data) - WIDTH) // STRIDE + 1
        out = self.tables[0].take(data[: n * STRIDE : STRIDE], axis=0)
        for j in range(1, WIDTH):
            out += self.tables[j].take(data[j : j + (n - 1) * STRIDE + 1 : STRIDE], axis=0)
        return out

    def halves(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per half chunk: each filter's largest activation and its position."""
        act = self.activations(data)
        size = HALF // STRIDE
        n = -(-len(act) // size)
        full = np.full((n * size, FILTERS), -np.inf, np.float32)
        full[: len(act)] = act
        full = full.reshape(n, size, FILTERS)
        where = full.argmax(axis=1)
        return np.take_along_axis(full, where[:, None, :], axis=1)[:, 0], where + (np.arange(n) * size)[:, None]

    def maxima(self, data: np.ndarray) -> np.ndarray:
        """As ``halves`` without positions, by pieces that overlap by a filter's width."""
        out = []
        for at in range(0, max(1, len(data)), PIECE):
            piece = data[at : at + PIECE + WIDTH - STRIDE]
            act = self.activations(piece)[: max(1, PIECE // STRIDE)]
            out.append(np.maximum.reduceat(act, np.arange(0, len(act), HALF // STRIDE), axis=0))
        return np.concatenate(out)

    def pooled(self, most: np.ndarray) -> np.ndarray:
        chunks = np.maximum(most[:-1], most[1:]) if len(most) > 1 else most
        return np.maximum(chunks + self.bias, 0).mean(axis=0)

    def score(self, data: np.ndarray) -> float:
        x = float(self.pooled(self.maxima(data)) @ self.weights + self.offset) if len(data) else self.offset
        return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def train(examples: list[tuple[bytes, int]], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Logistic loss, Adam; without examples of both labels the scores are the labels' mean (0.5 without any)."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    labels = np.array([y for _, y in examples], float)
    if not len(labels) or labels.min() == labels.max():
        mean = np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99)
        net.weights[:] = 0
        net.offset = float(np.log(mean / (1 - mean)))
        return net
    net.offset = float(np.log(labels.mean() / (1 - labels.mean())))
    params = [net.tables, net.bias, net.weights, np.array([net.offset], np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    texts = [np.frombuffer(x, np.uint8) for x, _ in examples]
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), STEP_DOCS):
            grads = [np.zeros_like(p) for p in params]
            batch = order[at : at + STEP_DOCS]
            for i in batch:
                if not len(texts[i]):
                    continue
                most, where = net.halves(texts[i])
                if len(most) > 1:  # a chunk is two halves: the larger of both
                    left = most[:-1] >= most[1:]
                    chunk, where = np.where(left, most[:-1], most[1:]), np.where(left, where[:-1], where[1:])
                else:
                    chunk = most
                live = chunk + net.bias > 0
                pooled = np.where(live, chunk + net.bias, 0).mean(axis=0)
                error = 1 / (1 + np.exp(-np.clip(pooled @ net.weights + params[3][0], -40, 40))) - labels[i]
                grads[2] += error * pooled
                grads[3] += error
                back = (error * net.weights / len(chunk) * live).astype(np.float32)
                grads[1] += back.sum(axis=0)
                padded = np.concatenate([texts[i], np.zeros(WIDTH, np.uint8)])
                columns = np.broadcast_to(np.arange(FILTERS), where.shape)
                for j in range(WIDTH):
                    np.add.at(grads[0][j], (padded[where * STRIDE + j], columns), back)
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                g /= len(batch)
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            net.offset = float(params[3][0])
    return net


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_docs: int = SAMPLE_DOCS) -> Network:
    """From ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0/1); about ``sample_docs`` whole texts of up to
    SAMPLE_BYTES, half of each label.  Runs its jobs when it is called.

    The sample is drawn from the labels, so its ids are few and only their texts are fetched.  Where a label has fewer
    rows than half the sample, all of them are taken.  Rows without text, doc_id or a label of 0 or 1 take no part; a
    repeated row, or a document with several labels, counts each time.
    """
    known = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    counts = {r.y: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, sample_docs / 2 / n))).otherwise(share)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES)).join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "text").toArrow()
    return train([(t.encode(), y) for t, y in zip(rows.column("text").to_pylist(), rows.column("y").to_pylist())])


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score): probability of label 1 of each row's whole text; null and empty texts get the network's prior.

    Repeated rows are scored each; an empty table gives no rows; other columns take no part.
    """
    sent = docs.sparkSession.sparkContext.broadcast((net.tables, net.bias, net.weights, net.offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(*sent.value)
        for batch in batches:
            texts = Texts(batch.column("text"))
            scores = [net.score(texts.data[a:b]) for a, b in zip(texts.offsets, texts.offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id long, score double")
