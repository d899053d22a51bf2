"""Language of texts by string kernels.

The kernel of two texts is the number of character n-grams of 1 to `LONGEST` letters that both have (presence,
not counts; words are padded with a blank), divided by the root of the product of their own numbers. Kernel ridge
regression, one language against the rest, works on Nyström features: the kernels with `landmarks`
texts. For scoring, both steps fold into one matrix per landmark and language, and a batch of documents is scored by two
matrix products.

The model is fitted on the driver from a bounded sample (`per_language` rows of each language); n-grams are
told apart by a hash of `BITS` bits.
"""

from __future__ import annotations

import functools
import sys
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

LONGEST, BITS = 3, 18
LANDMARKS, PER_LANGUAGE, RIDGE = 128, 500, 1e-3
# Characters whose n-grams are hashed at a time, and documents scored at a time.
PART, ROWS = 1 << 18, 64
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter, for all of them."""
    return np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])


class Model(NamedTuple):
    languages: list[str]
    column: np.ndarray  # of an n-gram's hash among those that landmarks have, or the last, unused one
    grams: np.ndarray  # (columns, landmarks): whether a landmark has the n-gram
    norms: np.ndarray  # of the landmarks
    weights: np.ndarray  # (landmarks, languages)


def _hashes(text: str) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of letters and blanks, in parts that overlap."""
    for at in range(0, max(len(text), 1), PART):
        part = text[max(at - LONGEST + 1, 0) : at + PART].lower()
        codes = np.frombuffer(f" {part} ".encode("utf-32-le", "replace"), np.uint32)
        letter = _letters()[codes]
        if not letter.any():
            continue
        # Anything else is a blank, and blanks in a row are one.
        codes = np.where(letter, codes, 32).astype(np.uint64)[letter | np.append(True, letter[:-1])]
        h = np.zeros(len(codes), np.uint64)
        for n in range(1, min(LONGEST, len(codes)) + 1):
            h = (h[: len(codes) - n + 1] + codes[n - 1 :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            yield (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)


def present(text: str, seen: np.ndarray) -> tuple[np.ndarray, int]:
    """The hashes of a text, with repeats, and how many different ones; `seen` holds 2**BITS false values."""
    found = np.concatenate([np.zeros(0, np.uint64), *_hashes(text)])
    seen[found] = True
    n = int(np.count_nonzero(seen))
    seen[found] = False
    return found, n


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Landmarks are dealt evenly to the languages, in the order of the texts."""
    names = sorted(set(languages))
    seen = np.zeros(1 << BITS, bool)
    sets = [present(t, seen) for t in texts]
    by_name = {name: [i for i, x in enumerate(languages) if x == name and sets[i][1]] for name in names}
    chosen = sorted(i for ids in by_name.values() for i in ids[: max(1, landmarks // max(len(names), 1))])
    if not chosen:
        return Model([], np.zeros(1 << BITS, np.int32), np.zeros((1, 0), np.float32), np.zeros(0, np.float32), np.zeros((0, 0), np.float32))
    known = np.unique(np.concatenate([sets[i][0] for i in chosen]))
    column = np.full(1 << BITS, len(known), np.int32)
    column[known] = np.arange(len(known))
    grams = np.zeros((len(known) + 1, len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        grams[column[sets[i][0]], j] = 1
    norms = np.sqrt([sets[i][1] for i in chosen]).astype(np.float32)
    model = Model(names, column, grams, norms, np.zeros((len(chosen), len(names)), np.float32))
    kernel = np.concatenate([_kernels(model, sets[i : i + ROWS]) for i in range(0, len(sets), ROWS)]).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[chosen])
    keep = values > 1e-6 * values[-1]
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    z = kernel @ whiten
    y = np.where(np.array(languages)[:, None] == np.array(names)[None], 1.0, -1.0)
    # Each language weighs the same, however many rows it has.
    size = np.array([languages.count(name) for name in names])
    w = 1 / size[[names.index(x) for x in languages]]
    a = z.T @ (z * w[:, None])
    weights = np.linalg.solve(a + ridge * np.eye(len(a)), z.T @ (y * w[:, None]))
    return model._replace(weights=(whiten @ weights).astype(np.float32))


def _kernels(model: Model, sets: list[tuple[np.ndarray, int]]) -> np.ndarray:
    x = np.zeros((len(sets), len(model.grams)), np.float32)
    for row, (found, _) in zip(x, sets):
        row[model.column[found]] = 1
    x[:, -1] = 0
    own = np.sqrt([max(n, 1) for _, n in sets]).astype(np.float32)
    return (x @ model.grams) / model.norms / own[:, None]


def classify(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """The language with the highest answer, and the answer brought to 0 to 1.

    Null, and texts without a letter, are `und` with 0. So is all if nothing was learned. Of equal answers the
    first language counts.
    """
    seen = np.zeros(1 << BITS, bool)
    out = []
    for i in range(0, len(texts), ROWS):
        sets = [present(t or "", seen) for t in texts[i : i + ROWS]]
        if not model.languages:
            out.extend((UNKNOWN, 0.0) for _ in sets)
            continue
        answers = _kernels(model, sets) @ model.weights
        best = answers.argmax(axis=1)
        for row, k, (_, n) in zip(answers, best.tolist(), sets):
            out.append((model.languages[k], float(np.clip((row[k] + 1) / 2, 0, 1))) if n else (UNKNOWN, 0.0))
    return out


def train(
    documents: DataFrame,
    may_train: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = PER_LANGUAGE,
    **options,
) -> Model:
    """From about `per_language` rows of each language, taken by a hash of id and language."""
    rows = documents.where(may_train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")
    )
    counts = dict(rows.groupBy("lang").count().collect())
    if not counts:
        return fit([], [])
    share = F.create_map(*(F.lit(x) for name, n in sorted(counts.items()) for x in (name, 1e6 * per_language / n)))
    drawn = rows.where(F.pmod(F.xxhash64("id", "lang"), F.lit(1_000_000)) < share[F.col("lang")]).collect()
    drawn = sorted({(r.id, r.lang, r.text) for r in drawn}, key=lambda r: (hash(r[0]) * 2654435761 % 4294967296, r))
    return fit([t for _, _, t in drawn], [x for _, x, _ in drawn], **options)


def predict(documents: DataFrame, model: Model, text: str = "text", to: str = "lang_pred", score: str = "score") -> DataFrame:
    """The documents with their language and its score in two new columns, without a shuffle."""
    taken = {c.lower() for c in documents.columns}
    for name in (to, score):
        if name.lower() in taken:
            raise ValueError(f"there is already a column {name!r}; {unused(name, documents.columns)!r} is free")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = classify(shared.value, batch.column(batch.schema.get_field_index(text)).to_pylist())
            new = [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, to, score])

    return documents.mapInArrow(
        run, T.StructType([*documents.schema.fields, T.StructField(to, T.StringType()), T.StructField(score, T.DoubleType())])
    )
