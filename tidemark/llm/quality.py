"""Quality of texts: a convolutional network over bytes.

Each filter looks at `WIDTH` neighbouring bytes, through a learned embedding of bytes. A document is cut
into chunks that overlap by `WIDTH` - 1 bytes, so that every place of the whole text is in one chunk; a filter
answers with its maximum in each chunk. The mean and the maximum of these answers over the chunks are
combined into one probability.

The network is fitted on the driver, on a bounded sample of the labelled rows (`per_class`, `train_bytes`), and is a
few hundred kB that tasks get with their code. Scoring is a pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import unused
from tidemark.session import runs_on_executors

runs_on_executors(__name__)

WIDTH, CHUNK, FILTERS, EMBEDDING = 6, 512, 16, 8
# A block of places whose answers are held at a time, a whole number of chunks.
STEP = CHUNK - WIDTH + 1
BLOCK = 128 * STEP
PER_CLASS, TRAIN_BYTES, EPOCHS, SEED = 1_000, 16_384, 12, 7
THRESHOLD = 0.7


class Network(NamedTuple):
    tables: np.ndarray  # (WIDTH, 256, FILTERS): what a byte at a place adds to each filter
    bias: np.ndarray
    weights: np.ndarray  # of the means, then of the maxima
    offset: float


def _answers(data: np.ndarray, tables: np.ndarray, arg: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each filter's maximum per chunk, before bias, and with `arg` the places of the maxima.

    A text shorter than a filter is padded with zero bytes; the empty one is a single such chunk.
    """
    if len(data) < WIDTH:
        data = np.concatenate([data, np.zeros(WIDTH - len(data), np.uint8)])
    places = len(data) - WIDTH + 1
    found, where = [], []
    for at in range(0, places, BLOCK):
        n = min(BLOCK, places - at)
        total = tables[0].take(data[at : at + n], axis=0)
        for w in range(1, WIDTH):
            total += tables[w].take(data[at + w : at + w + n], axis=0)
        starts = range(0, n, STEP)
        found.append(np.maximum.reduceat(total, np.array(starts), axis=0))
        if arg:
            where.append(np.array([total[s : s + STEP].argmax(axis=0) + s + at for s in starts]))
    return np.concatenate(found), np.concatenate(where) if arg else None


def _features(top: np.ndarray, bias: np.ndarray) -> np.ndarray:
    top = np.maximum(top + bias, 0)
    return np.concatenate([top.mean(axis=0), top.max(axis=0)])


def probability(network: Network, text: str | None) -> float:
    """Of label 1; null is scored as the empty text."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    top, _ = _answers(data, network.tables)
    z = float(_features(top, network.bias) @ network.weights) + network.offset
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(texts: list[str], labels: list[int], share: float, epochs: int = EPOCHS, train_bytes: int = TRAIN_BYTES, seed: int = SEED) -> Network:
    """By Adam, one document at a time in small groups; `share` is label 1's part of all labelled rows.

    Of a longer text a window of `train_bytes` is looked at per epoch, another one each time.
    """
    rng = np.random.default_rng(seed)
    p = {
        "e": rng.normal(0, 1, (256, EMBEDDING)).astype(np.float32),
        "f": rng.normal(0, (WIDTH * EMBEDDING) ** -0.5, (WIDTH, EMBEDDING, FILTERS)).astype(np.float32),
        "b": np.zeros(FILTERS, np.float32),
        "w": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        "o": np.zeros(1, np.float32),
    }
    data = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t in texts]
    ones = sum(labels)
    n = len(labels)
    # Classes weigh as they do among all labelled rows, whatever the sample.
    weigh = {1: share * n / ones if ones else 1.0, 0: (1 - share) * n / (n - ones) if n > ones else 1.0}
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    tables = np.einsum("be,wef->wbf", p["e"], p["f"])
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(n)
        for group in np.array_split(order, max(1, n // 16)):
            g = {k: np.zeros_like(x) for k, x in p.items()}
            for i in group.tolist():
                text = data[i]
                if len(text) > train_bytes:
                    at = int(rng.integers(len(text) - train_bytes + 1))
                    text = text[at : at + train_bytes]
                if len(text) < WIDTH:
                    text = np.concatenate([text, np.zeros(WIDTH - len(text), np.uint8)])
                top, place = _answers(text, tables, True)
                x = _features(top, p["b"])
                z = float(x @ p["w"] + p["o"][0])
                d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]) * weigh[labels[i]] / len(group)
                g["w"] += d * x
                g["o"] += d
                chunks = len(top)
                up = np.tile(d * p["w"][:FILTERS] / chunks, (chunks, 1))
                up[top.argmax(axis=0), np.arange(FILTERS)] += d * p["w"][FILTERS:]
                up *= top + p["b"] > 0
                g["b"] += up.sum(axis=0)
                for w in range(WIDTH):
                    byte = text[place + w]  # (chunks, FILTERS)
                    g["f"][w] += np.einsum("cfe,cf->ef", p["e"][byte], up)
                    np.add.at(g["e"], byte.ravel(), (up[:, :, None] * p["f"][w].T[None]).reshape(-1, EMBEDDING))
            step += 1
            for k, x in p.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                x -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                if k == "w":
                    x *= 1 - 0.01 * rate
            tables = np.einsum("be,wef->wbf", p["e"], p["f"])
    return Network(np.ascontiguousarray(tables, np.float32), p["b"], p["w"], float(p["o"][0]))


def train(
    documents: DataFrame,
    labels: DataFrame,
    may_train: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    per_class: int = PER_CLASS,
    **options,
) -> Network:
    """A network from about `per_class` labelled rows of each label, taken by a hash of their ids.

    `may_train` judges the labels' `doc_id`. Rows without a label or text don't count; labels other than
    0 and 1 neither. Without any labelled row the network answers 0.5; with one label only, that label.
    """
    marked = labels.where(may_train & F.col(label).isin(0, 1)).select(
        F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")
    )
    counts = dict(marked.groupBy("label").count().collect())
    total = sum(counts.values())
    if not total:
        return Network(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), 0.0)
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    bound = F.when(F.col("label") == 1, F.lit(1e6 * per_class / max(counts.get(1, 1), 1))).otherwise(
        F.lit(1e6 * per_class / max(counts.get(0, 1), 1))
    )
    drawn = marked.where(draw < bound)
    rows = (
        documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
        .where(F.col("text").isNotNull())
        .join(F.broadcast(drawn), "id")
        .select("id", "text", "label")
        .collect()
    )
    rows = sorted({(r.id, r.text, r.label) for r in rows})
    return fit([t for _, t, _ in rows], [y for _, _, y in rows], counts.get(1, 0) / total, **options)


def score(documents: DataFrame, network: Network, text: str = "text", to: str = "score") -> DataFrame:
    """The documents with a probability in the new column `to`; null texts are scored as empty ones.

    A column that has the name already, in any case, is an error.
    """
    if to.lower() in {c.lower() for c in documents.columns}:
        raise ValueError(f"there is already a column {to!r}; {unused(to, documents.columns)!r} is free")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            found = [probability(network, t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, to])

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField(to, T.DoubleType())]))
