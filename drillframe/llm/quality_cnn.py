"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters slide over all bytes of a text. Overlapping chunks (two blocks each, a block apart) cover the whole
text; each filter's response is max-pooled over a chunk, and the chunks' pooled responses are combined by mean, maximum
and minimum into one logistic unit, whose output is the probability of label 1. The minimum tells texts with a chunk in
which little varies. Filters add up one table entry per byte under them; tables for two neighbouring bytes halve the
look-ups. Blocks of many texts are computed together, so that memory is bounded by SEGMENT, not by the longest text.

Trained here by Adam on a bounded sample (SAMPLE_ROWS labelled rows, whole texts) outside the held-out fold.

Edge cases: a null text counts as empty; an empty text is one chunk of padding; repeated rows score alike and each
keeps its row; without labelled rows the score is the network's initial one; an empty table gives an empty result;
further columns of the input are ignored (kept by drop_low_quality()), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, plain_text

#: Most labelled rows that the network is trained on.
SAMPLE_ROWS = 3000
FILTERS, WIDTH, BLOCK, EPOCHS, BATCH, RATE = 16, 6, 256, 8, 24, 0.03
THRESHOLD = 0.3
#: Bytes computed at once.
SEGMENT = 1 << 17


def blocks_of(data: bytes) -> np.ndarray:
    """The bytes as rows of one block each, padded with zeros; each row also has the first bytes of the next."""
    n = max(1, -(-len(data) // BLOCK))
    flat = np.zeros(n * BLOCK + WIDTH, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.as_strided(flat, (n, BLOCK + WIDTH - 1), (BLOCK, 1))


def chunks_of(block_max: np.ndarray) -> np.ndarray:
    """Maxima over chunks of two neighbouring blocks; a lone block is a chunk."""
    return np.maximum(block_max[:-1], block_max[1:]) if len(block_max) > 1 else block_max


class Network:
    def __init__(self, seed: int = 1, prior: float = 0.5):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.offset = np.zeros(FILTERS, np.float32)
        self.weight = rng.normal(0, 0.1, 3 * FILTERS).astype(np.float32)
        self.bias = np.array([np.log(prior / (1 - prior))], np.float32)
        self.pairs: list[np.ndarray] = []

    def freeze(self) -> Network:
        """Tables for two neighbouring bytes, for scoring."""
        self.pairs = [np.ascontiguousarray((self.table[k][:, None] + self.table[k + 1][None]).reshape(65536, FILTERS)) for k in range(0, WIDTH, 2)]
        return self

    def respond(self, rows: np.ndarray) -> np.ndarray:
        """Responses (row, position, filter) of blocks."""
        codes = rows[:, :-1].astype(np.int32) * 256 + rows[:, 1:]
        out = self.pairs[0][codes[:, :BLOCK]]
        for k in range(1, WIDTH // 2):
            out += self.pairs[k][codes[:, 2 * k : 2 * k + BLOCK]]
        return out

    def combine(self, block_max: np.ndarray) -> np.ndarray:
        pooled = np.tanh(chunks_of(block_max) + self.offset)
        return np.concatenate([pooled.mean(0), pooled.max(0), pooled.min(0)])

    def probability(self, logit: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

    def score_all(self, texts: list[bytes]) -> list[float]:
        """Probabilities; blocks of many texts go through the filters together."""
        out: list[float] = []
        rows: list[np.ndarray] = []
        ends: list[int] = []

        def flush() -> None:
            if not rows:
                return
            every = np.concatenate(rows)
            step = max(1, SEGMENT // BLOCK)
            top = np.concatenate([self.respond(every[i : i + step]).max(axis=1) for i in range(0, len(every), step)])
            for start, end in zip([0, *ends], ends):
                out.append(self.probability(self.combine(top[start:end]) @ self.weight + self.bias[0]))
            rows.clear()
            ends.clear()

        for data in texts:
            rows.append(blocks_of(data))
            ends.append((ends[-1] if ends else 0) + len(rows[-1]))
            if ends[-1] * BLOCK >= 8 * SEGMENT:
                flush()
        flush()
        return out

    def train(self, sample: list[tuple[bytes, int]], epochs: int = EPOCHS, seed: int = 1) -> Network:
        """Adam on the logistic loss; gradients go to the positions that won the pooling."""
        rng = np.random.default_rng(seed)
        parts = [self.table, self.offset, self.weight, self.bias]
        first, second, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
        rows = [blocks_of(t) for t, _ in sample]
        labels = np.array([y for _, y in sample], np.float32)
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs)
            order = rng.permutation(len(sample))
            for at in range(0, len(order), BATCH):
                grads = [np.zeros_like(p) for p in parts]
                chosen = order[at : at + BATCH]
                for i in chosen:
                    self._gradient(rows[i], labels[i], grads, 1 / len(chosen))
                grads[2] += 1e-3 * self.weight
                step += 1
                for p, g, m, v in zip(parts, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        return self

    def _gradient(self, rows: np.ndarray, label: float, grads: list[np.ndarray], share: float) -> None:
        top = np.empty((len(rows), FILTERS), np.float32)
        won = np.empty((len(rows), FILTERS), np.int64)
        step = max(1, SEGMENT // BLOCK)
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            got = self.table[0][part[:, :BLOCK]]
            for k in range(1, WIDTH):
                got += self.table[k][part[:, k : k + BLOCK]]
            won[i : i + step] = got.argmax(axis=1)
            top[i : i + step] = got.max(axis=1)
        raw = chunks_of(top)
        pooled = np.tanh(raw + self.offset)
        n, every = len(pooled), np.arange(FILTERS)
        high, low = pooled.argmax(0), pooled.argmin(0)
        features = np.concatenate([pooled.mean(0), pooled[high, every], pooled[low, every]])
        error = (self.probability(float(features @ self.weight + self.bias[0])) - label) * share
        grads[2] += error * features
        grads[3] += error
        back = np.tile(error * self.weight[:FILTERS] / n, (n, 1)).astype(np.float32)
        back[high, every] += error * self.weight[FILTERS : 2 * FILTERS]
        back[low, every] += error * self.weight[2 * FILTERS :]
        back *= 1 - pooled**2
        grads[1] += back.sum(0)
        block = np.arange(n)[:, None] + (top[:-1] < top[1:] if len(top) > 1 else np.zeros((1, FILTERS), int))
        position = won[block, every]
        for k in range(WIDTH):
            np.add.at(grads[0][k], (rows[block, position + k], np.broadcast_to(every, block.shape)), back)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Network:
    """A network trained on at most `rows` labelled rows outside the held-out fold."""
    sample = [(t.encode(), y) for t, y in labelled_sample(docs, labels, "quality", rows)]
    if not sample:
        return Network().freeze()
    share = (sum(y for _, y in sample) + 1) / (len(sample) + 2)
    return Network(prior=share).train(sample).freeze()


def scores(docs: DataFrame, network: Network) -> DataFrame:
    """rest (the columns of docs but text, packed), text and score of each row."""
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("rest"), plain_text().alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((network.table, network.offset, network.weight, network.bias))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network()
        own.table, own.offset, own.weight, own.bias = shared.value
        own.freeze()
        for b in batches:
            score = own.score_all([t.as_py().encode() for t in b["text"]])
            yield pa.RecordBatch.from_arrays([b["rest"], b["text"], pa.array(score, pa.float64())], ["rest", "text", "score"])

    return rows.mapInArrow(mapped, f"rest {rows.schema['rest'].dataType.simpleString()}, text string, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, one row per document."""
    out = scores(docs.select("doc_id", "text"), fit(docs, labels)).select("rest.doc_id", "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score below the threshold."""
    kept = scores(docs, fit(docs, labels)).where(F.col("score") >= THRESHOLD)
    return kept.select(*[F.col(c) if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns])
