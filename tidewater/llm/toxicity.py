"""Toxicity scores from subword-bag embeddings and a linear softmax.

A word is the bag of its character n-grams and itself, hashed to a table of
embeddings; a window of words is the average of its words' averages; a linear
softmax of two classes reads it. Embeddings and softmax are trained jointly, in
numpy, on a bounded sample of labelled rows. A text's score is that of its most
toxic window, so that one remark in a long text counts as in a short one;
training pools windows ever more sharply towards that maximum. Words never seen
share n-gram vectors with those they resemble.

With a linear softmax, what a word adds to a window's margin is one number, so
scoring is a look-up a word, a running sum and a maximum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import fields, small_batches

#: Labelled rows that training takes at most, each with its whole text; scoring knows no such bound.
SAMPLE_ROWS = 4000
BUCKETS = 1 << 18
DIM = 16
WINDOW = 8
MEMO = 200_000
GRAMS = (3, 5)
THRESHOLD = 0.3


def words_of(text: str | None) -> list[str]:
    """Words in lower case; a run of one word counts once, so that repetition isn't taken for emphasis."""
    words = (text or "").lower().split()
    return [w for w, before in zip(words, ["", *words]) if w != before]


def normal(word: str) -> str:
    """Letters and digits of a word in lower case."""
    return word if word.isalnum() else "".join(filter(str.isalnum, word))


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams (3 to 5 characters, begin and end marked) and of the words themselves; each bucket's word."""
    marked = [f"<{w}>" for w in words]
    sizes = np.array([len(m) for m in marked], np.int64)
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(chars))
    buckets = [np.array([crc32(m.encode("utf-8", "surrogatepass")) % BUCKETS for m in marked], np.int64)]
    owners = [np.arange(len(words))]
    rolled = chars.copy()
    for n in range(2, GRAMS[1] + 1):
        rolled = rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1 :] if len(rolled) > 1 else rolled[:0]
        if n >= GRAMS[0]:
            inside = at[: len(rolled)] + n <= ends[: len(rolled)]
            mixed = (rolled[inside] ^ (rolled[inside] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            buckets.append((mixed >> np.uint64(40)).astype(np.int64) % BUCKETS)
            owners.append(owner[: len(rolled)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    """``margin[bucket]``: what a subword adds to the log-odds of a bag of its own; ``bias``: those of no words."""

    margin: np.ndarray
    bias: float

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer(dict):
    """Margins by lower-cased word; forgets all of them beyond ``MEMO`` words."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > MEMO:
            self.clear()
            new = list(words)
        if new:
            ids, owner = subwords(list(map(normal, new)))
            sums = np.bincount(owner, self.model.margin[ids], len(new))
            self.update(zip(new, (sums / np.bincount(owner, minlength=len(new))).tolist(), strict=True))

    def scores(self, texts: list[str | None]) -> list[float]:
        rows = [words_of(t) for t in texts]
        self.learn(set().union(*rows))
        return [self.score(words) for words in rows]

    def score(self, words: list[str]) -> float:
        margins = np.fromiter(map(self.__getitem__, words), np.float64, len(words))
        best = window_means(margins).max() if words else 0.0
        return float(1 / (1 + np.exp(-np.clip(best + self.model.bias, -50, 50))))


def window_means(x: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Means of every ``size`` neighbours; of all and zeros for those missing if there are fewer."""
    if len(x) <= size:
        return np.array([x.sum() / size])
    total = np.concatenate([[0.0], np.cumsum(x)])
    return (total[size:] - total[:-size]) / size


def summed(at: np.ndarray, values: np.ndarray, of: np.ndarray, n: int, step: int = 500_000) -> np.ndarray:
    """``values[of]`` added up by ``at``, in parts: the indices are by far the longest arrays of training."""
    out = np.zeros(n)
    for i in range(0, len(at), step):
        out += np.bincount(at[i : i + step], values[of[i : i + step]], n)
    return out


def train(texts: list[str], labels: np.ndarray, epochs: int = 100, rate: float = 0.3, seed: int = 7) -> Model:
    """Full-batch descent on cross-entropy, each step scaled to move the most pulled weight by ``rate``, falling to zero.

    What many documents share is pulled most, so it is learned before what one
    document happens to hold. One class only, or no rows: a constant score near
    that class.
    """
    y = np.asarray(labels, np.float64)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(BUCKETS), 6.0 * (2 * y.mean() - 1) if len(y) else -6.0)
    place: dict[str, int] = {}
    docs = [np.array([place.setdefault(w, len(place)) for w in map(normal, words_of(t))], np.int32) for t in texts]
    lengths = np.array([len(d) for d in docs])
    row = np.concatenate(docs)
    names = list(place)
    del docs, place
    ids, word = [], []
    for i in range(0, len(names), 20_000):
        buckets, owners = subwords(names[i : i + 20_000])
        ids.append(buckets.astype(np.int32))
        word.append((owners + i).astype(np.int32))
    n_words = len(names)
    del names
    ids, word = np.concatenate(ids), np.concatenate(word)
    sizes = np.bincount(word, minlength=n_words)
    # Half-overlapping windows of all documents, as ranges of one long row of words.
    half = WINDOW // 2
    windows = -(-np.maximum(lengths - half, 1) // half)
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), windows)
    doc_start = np.cumsum(windows) - windows
    inside = half * (np.arange(len(owner)) - doc_start[owner])
    begin = (np.cumsum(lengths) - lengths)[owner]
    first = (begin + inside).astype(np.int32)
    last = (begin + np.minimum(inside + WINDOW, lengths[owner])).astype(np.int32)
    del inside, begin

    # A bucket's pull is weighed by the root of how much of the texts it is: a common word's chance surplus is no evidence.
    part = np.repeat(1 / np.maximum(lengths, 1), lengths)
    mass = summed(ids, np.bincount(row, part, n_words) / sizes, word, BUCKETS)
    scale = 1 / np.sqrt(mass + 3 * part.mean() / sizes.mean())
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
    weights = rng.normal(0, 1.0, (DIM, 2))
    bias = np.log(y.mean() / (1 - y.mean()))
    for epoch in range(epochs):
        diff = weights[:, 1] - weights[:, 0]
        by_word = summed(word, table @ diff, ids, n_words) / sizes
        total = np.concatenate([[0.0], np.cumsum(by_word[row])])
        margin = (total[last] - total[first]) / WINDOW
        # Softmax pooling: the mean of the windows at first, near the maximum at last.
        sharp = np.exp((6.0 * epoch / epochs) * (margin - np.maximum.reduceat(margin, doc_start)[owner]))
        share = sharp / np.add.reduceat(sharp, doc_start)[owner]
        logit = np.add.reduceat(share * margin, doc_start) + bias
        error = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y) / len(y)
        pull = share * error[owner] / WINDOW
        change = np.bincount(first, pull, len(row) + 1) - np.bincount(last, pull, len(row) + 1)
        for_word = np.bincount(row, np.cumsum(change)[:-1], n_words)
        for_bucket = scale * summed(ids, for_word / sizes, word, BUCKETS)
        g_diff = (for_bucket / scale) @ table
        step = rate * (1 - epoch / epochs)
        pace = step / (np.abs(for_bucket).max() * np.abs(diff).max() + 1e-30)
        table -= np.outer((pace * for_bucket).astype(np.float32), diff.astype(np.float32))
        weights -= 0.1 * step / (np.abs(g_diff).max() + 1e-30) * np.stack([-g_diff, g_diff], 1)
        bias -= 2 * step * error.sum()
    return Model(table @ (weights[:, 1] - weights[:, 0]), float(bias))


def is_held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the id as text leaves 2 modulo 4; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on at most ``SAMPLE_ROWS`` labelled rows, chosen by a hash of their ids; of repeated ids and labels one counts.

    Rows with a null id, label or text and those held out are not learned from.
    The rows of the sample meet in one task, which trains; the driver gets the
    finished weights alone, and a lost executor costs one more training.
    """
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    # at most SAMPLE_ROWS narrow rows are broadcast
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("double").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            labels += b.column(1).to_pylist()
        model = train(texts, np.array(labels, np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([model.margin.astype(np.float64).tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], ["margin", "bias"])

    got = rows.repartition(1).sortWithinPartitions("doc_id").select("text", "toxic").mapInArrow(run, "margin binary, bias double").first()
    if got is None:  # nothing to learn from: the task may not even run
        return train([], np.zeros(0))
    return Model(np.frombuffer(got["margin"], np.float64), got["bias"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` for every row: nulls and empty texts get the score of no words; repeated rows and ties the same score.

    Other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer.scores(b.column(1).to_pylist()), pa.float64())], ["id", "score"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"{fields(src, 'id')}, score double")


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns and their order stay."""
    small_batches(docs.sparkSession)
    position = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in batches:
            stay = np.array(scorer.scores(b.column(position).to_pylist())) < threshold
            yield b.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
