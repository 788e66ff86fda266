"""Quality of whole texts by a convolutional network over their bytes, in numpy.

Each byte has an embedding of DEPTH numbers; FILTERS filters look at WIDTH bytes at every position. A text is cut into
chunks of CHUNK positions, each chunk reading the WIDTH - 1 bytes after it too, so that chunks overlap and every stretch
of the text is under every filter, to its end. A chunk's filters are max-pooled; a text's features are the largest and
the mean of its chunks' values; a logistic unit makes one probability of them. Gradients flow to the positions that won the pooling.

The network is fitted on a sample of labelled rows, about ROWS of each label (the bound), with whole texts; the intercept is
moved from the sample's balance to that of all labelled rows.

Defined results: null and empty texts are one chunk of padding and get the score that the network gives it; without labelled rows
of both kinds the score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.sampling import labelled, remainder
from tidewell.llm.textbatch import over_slices

#: Labelled rows to learn from, for each label, about.
ROWS = 1200
DEPTH, WIDTH, FILTERS, CHUNK = 8, 8, 16, 512
EPOCHS, BATCH, RATE = 6, 16, 0.01
#: Chunks that go through the filters at a time.
BLOCK = 32


@dataclass
class Network:
    embedding: np.ndarray
    filters: np.ndarray
    offsets: np.ndarray
    weights: np.ndarray
    intercept: float = 0.0
    constant: float | None = field(default=None)

    @classmethod
    def new(cls, seed: int) -> Network:
        rnd = np.random.default_rng(seed)
        shape = (DEPTH * WIDTH, FILTERS)
        return cls(
            rnd.normal(0, 0.5, (256, DEPTH)).astype(np.float32), rnd.normal(0, 1 / math.sqrt(shape[0]), shape).astype(np.float32), np.zeros(FILTERS, np.float32),
            rnd.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        )

    def _chunks(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts' bytes, each text with zeros behind; where each chunk starts and ends in them; the text of each chunk."""
        data = np.frombuffer(b"".join(t + bytes(WIDTH) for t in texts), np.uint8)
        size = np.array([max(1, len(t)) for t in texts], np.int64)
        at = np.cumsum([len(t) + WIDTH for t in texts]) - [len(t) + WIDTH for t in texts]
        chunks = -(-size // CHUNK)
        owner = np.repeat(np.arange(len(texts)), chunks)
        start = (np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)) * CHUNK
        return data, np.repeat(at, chunks) + start, np.repeat(at, chunks) + np.minimum(start + CHUNK, np.repeat(size, chunks)), owner

    def _pool(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Max-pooled filters of each chunk; with places also the positions of the maxima."""
        pooled = np.empty((len(starts), FILTERS), np.float32)
        won = np.empty((len(starts), FILTERS), np.int64) if places else None
        for i in range(0, len(starts), BLOCK):
            lo, hi = starts[i], ends[i : i + BLOCK][-1]
            seen = self.embedding[data[lo : hi + WIDTH - 1]]
            windows = np.lib.stride_tricks.as_strided(seen, (hi - lo, DEPTH * WIDTH), (DEPTH * 4, 4))
            values = np.ascontiguousarray(windows) @ self.filters
            bounds = np.stack([starts[i : i + BLOCK] - lo, ends[i : i + BLOCK] - lo], 1)
            if not places:
                cuts = bounds.ravel()[:-1]  # between a chunk's end and the next one's start lies padding, or nothing
                cuts = cuts[np.append(True, cuts[1:] > cuts[:-1])]
                top = np.maximum.reduceat(values, cuts, axis=0)
                pooled[i : i + BLOCK] = top[np.searchsorted(cuts, bounds[:, 0])]
                continue
            for k, (a, b) in enumerate(bounds, i):
                best = values[a:b].argmax(0)
                pooled[k], won[k] = values[a + best, np.arange(FILTERS)], lo + a + best
        return np.maximum(pooled + self.offsets, 0), won

    def _features(self, pooled: np.ndarray, owner: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        mean = np.add.reduceat(pooled, first, axis=0) / np.diff(np.append(first, len(owner)))[:, None]
        return np.concatenate([np.maximum.reduceat(pooled, first, axis=0), mean], 1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The probability of label 1 for each text."""
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        data, starts, ends, owner = self._chunks(texts)
        x = self._features(self._pool(data, starts, ends, False)[0], owner)
        return 1 / (1 + np.exp(-np.clip(x.astype(float) @ self.weights + self.intercept, -60, 60)))

    def _step(self, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss."""
        data, starts, ends, owner = self._chunks(texts)
        pooled, won = self._pool(data, starts, ends, True)
        x = self._features(pooled, owner)
        error = (1 / (1 + np.exp(-np.clip(x @ self.weights + self.intercept, -60, 60))) - y) / len(y)
        high = x[owner, :FILTERS] == pooled
        high &= np.cumsum(high, 0) - np.concatenate([np.zeros((1, FILTERS), int), np.cumsum(high, 0)])[np.searchsorted(owner, owner)] == 1
        share = self.weights[:FILTERS] * high + self.weights[FILTERS:] / np.bincount(owner)[owner][:, None]
        back = (error[owner][:, None] * share * (pooled > 0)).astype(np.float32)
        around = data[won[..., None] + np.arange(WIDTH)]  # chunk, filter, byte
        seen = self.embedding[around].reshape(*won.shape, DEPTH * WIDTH)
        to_bytes = (back[..., None] * self.filters.T).reshape(*won.shape, WIDTH, DEPTH)
        embedding = np.zeros_like(self.embedding)
        np.add.at(embedding, around, to_bytes)
        return {"embedding": embedding, "filters": np.einsum("cf,cfd->df", back, seen), "offsets": back.sum(0), "weights": error @ x, "intercept": error.sum()}

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = 1) -> Network:
        """Adam over shuffled batches of texts."""
        rnd, beta, gamma = np.random.default_rng(seed), 0.9, 0.999
        mean: dict = {}
        square: dict = {}
        t = 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            order = rnd.permutation(len(texts))
            for i in range(0, len(order), BATCH):
                some, t = order[i : i + BATCH], t + 1
                for name, g in self._step([texts[k] for k in some], labels[some]).items():
                    mean[name] = beta * mean.get(name, 0) + (1 - beta) * g
                    square[name] = gamma * square.get(name, 0) + (1 - gamma) * g * g
                    change = rate * (mean[name] / (1 - beta**t)) / (np.sqrt(square[name] / (1 - gamma**t)) + 1e-8)
                    value = getattr(self, name) - change
                    setattr(self, name, float(value) if name == "intercept" else value.astype(np.float32))
        return self


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS, mod: int = 3, fold: int = 1) -> Network:
    """A network for labels.label, from rows whose crc32(doc_id) modulo mod isn't fold."""
    table, many = labelled(docs, labels, label, ~remainder("doc_id", mod).isin(fold, -1), rows, "bytecnn")
    net = Network.new(seed=7)
    if not all(many.get(k) for k in (0, 1)):
        net.constant = 0.5 if not many else float(many.get(1, 0) > 0)
        return net
    texts = [(t or "").encode() for t in table["text"].to_pylist()]
    y = table["label"].to_numpy().astype(np.float32)
    net.fit(texts, y)
    net.intercept += math.log(many[1] / many[0]) - math.log(max(1, (y == 1).sum()) / max(1, (y == 0).sum()))
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """docs with score and predicted."""
    shipped = docs.sparkSession.sparkContext.broadcast(net)
    columns = docs.columns
    at = columns.index("text")

    def make():
        net = shipped.value

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            found = net.score([(t or "").encode() for t in part.column(at).to_pylist()])
            return pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], [*columns, "score", "predicted"])

        return step

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return over_slices(docs, "text", make, f"{schema}, score double, predicted int", most=1 << 20)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    net = learn(docs, labels)
    return score(docs.select("doc_id", (remainder("doc_id", 3) == F.lit(1)).alias("held_out"), "text"), net).drop("text")
