"""Masked pseudo-likelihood: bidirectional window networks score documents.

A word is a class and, in a class of several words, itself. The commonest words
of the whole corpus are classes of their own, the others share hashed ones. The
probability of a word given two words on either side is that of its class given
their classes, times that of the word in its class; a document's score is the
sum of the logarithms over all its words, each masked in turn.

Classes are predicted by two networks (an embedding for each side, a hidden
layer), one reading the neighbours at distance one, one those at distance two.
Given the word, the two pairs are taken as independent: their log-probabilities
add up, less those of the class alone, and are normalised over all classes. The
networks are trained, in numpy, on the counts of all (left, word, right) triples
of the corpus at their distance; there are at most ``CLASSES`` cubed of them,
which bounds what the driver gathers, whatever the corpus.

Words in their classes are counted over the whole corpus. Those counts grow with
it, so they stay a table: scoring joins it with the words that documents hold.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import cut, fields, small_batches

#: Classes: 0 stands beyond both ends of a text, then common words, then hashed ones.
CLASSES = 128
HASHED = 32
#: Words read on either side; words that are scored at a time.
WINDOW = 2
CHUNK = 8192
#: Words of hashed classes, the commonest, whose counts go to every task at most (16 bytes each); the others' are joined.
LISTED = 1 << 18
COMMON = CLASSES - HASHED - 1
DIM = 24
HIDDEN = 48
#: Distinct words that a task counts before it hands them on.
FLUSH = 300_000


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def hashes_of(words: list[str]) -> np.ndarray:
    """XXH64 of each word, as the engine's own function gives it."""
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seed=42) for w in words), np.uint64, len(words)).view(np.int64)


class Classes(dict):
    """Class by word; those of hashed classes aren't kept: the last bits of their hash tell."""

    def __init__(self, common: list[str]) -> None:
        super().__init__((w, i + 1) for i, w in enumerate(common))
        self.first = CLASSES - HASHED

    def __missing__(self, word: str) -> int:
        return self.first + int(hashes_of([word])[0]) % HASHED

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Classes of a text's words, with ``WINDOW`` ends before and after, and the hashes of the words of hashed classes, in order."""
        words = words_of(text)
        c = np.zeros(len(words) + 2 * WINDOW, np.int64)
        known = c[WINDOW : WINDOW + len(words)]
        known[:] = [self.get(w, 0) for w in words]
        rare = np.flatnonzero(known == 0)
        h = hashes_of([words[i] for i in rare])
        known[rare] = self.first + h % HASHED
        return c, h

    def of(self, text: str | None) -> np.ndarray:
        return self.read(text)[0]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, n)`` over all documents; tasks hand on what they have counted, a shuffle adds it up."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for b in batches:
            for t in b.column(0).to_pylist():
                held.update(words_of(t))
            if len(held) > FLUSH:
                yield out()
        yield out()

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def triple_counts(docs: DataFrame, common: list[str], text_col: str = "text") -> DataFrame:
    """``(distance, triple, n)`` over all documents; a triple is (left * CLASSES + right) * CLASSES + word."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(common)
        total = np.zeros((WINDOW, CLASSES**3), np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                c = classes.of(t)
                n = len(c) - 2 * WINDOW
                for d in range(1, WINDOW + 1) if n else ():
                    left, right = c[WINDOW - d : WINDOW - d + n], c[WINDOW + d : WINDOW + d + n]
                    np.add.at(total[d - 1], (left * CLASSES + right) * CLASSES + c[WINDOW : WINDOW + n], 1)
        for d in range(WINDOW):
            seen = np.flatnonzero(total[d])
            for at in range(0, len(seen), 100_000):
                part = seen[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), d + 1, np.int32)), pa.array(part), pa.array(total[d][part])], ["distance", "triple", "n"])

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "distance int, triple long, n long")
    return parts.groupBy("distance", "triple").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """``common`` words; ``tables[distance - 1][left, right, word]``: log-probabilities of classes; ``prior``: those of classes alone.

    ``totals``: words in each hashed class. ``listed`` and ``times``: hashes,
    sorted, and counts of their commonest words; ``words``: a written table
    ``(h, n)`` of the others that occur more than once.
    """

    common: list[str]
    tables: list[np.ndarray]
    prior: np.ndarray
    totals: np.ndarray
    listed: np.ndarray
    times: np.ndarray
    words: DataFrame | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"words": None}

    def class_scores(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probability of the class at each of the positions ``at`` of ``c``, given those around it."""
        out = np.zeros(len(at))
        for i in range(0, len(at), CHUNK):
            p = at[i : i + CHUNK]
            x = -(WINDOW - 1) * self.prior[None, :]
            for d, table in enumerate(self.tables, 1):
                x = x + table[c[p - d], c[p + d]]
            x[:, 0] = -np.inf  # a word is never beyond an end
            top = x.max(1)
            out[i : i + CHUNK] = x[np.arange(len(p)), c[p]] - top - np.log(np.exp(x - top[:, None]).sum(1))
        return out

    def score(self, classes: np.ndarray) -> float:
        """Summed log-probability of the classes of one text; no words: 0."""
        return float(self.class_scores(classes, np.arange(WINDOW, len(classes) - WINDOW)).sum())


def forward(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hidden layer and log-probabilities for all pairs of neighbours; a word is never beyond an end."""
    hidden = np.tanh((p["left"] @ p["in_l"])[:, None, :] + (p["right"] @ p["in_r"])[None, :, :] + p["bias_h"]).reshape(-1, HIDDEN)
    logits = hidden @ p["out"] + p["bias_o"]
    logits[:, 0] = -1e9
    logits -= logits.max(1, keepdims=True)
    return hidden, logits - np.log(np.exp(logits).sum(1, keepdims=True))


def train(triples: np.ndarray, n: np.ndarray, epochs: int = 120, rate: float = 0.02, seed: int = 5) -> np.ndarray:
    """``table[left, right, word]`` by full-batch Adam on the cross-entropy of all counted triples. No triples: a uniform table."""
    rng = np.random.default_rng(seed)
    shape = {"left": (CLASSES, DIM), "right": (CLASSES, DIM), "in_l": (DIM, HIDDEN), "in_r": (DIM, HIDDEN), "bias_h": (HIDDEN,), "out": (HIDDEN, CLASSES), "bias_o": (CLASSES,)}
    p = {k: rng.normal(0, 0.3 if len(s) > 1 else 0, s).astype(np.float32) for k, s in shape.items()}
    counts = np.zeros(CLASSES**3, np.float32)
    counts[triples] = n
    counts = counts.reshape(-1, CLASSES)
    total = float(counts.sum())
    if not total:
        p = {k: np.zeros_like(x) for k, x in p.items()}
        epochs = 0
    weight = counts.sum(1, keepdims=True)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for step in range(1, epochs + 1):
        hidden, logs = forward(p)
        d_logits = (np.exp(logs) * weight - counts) / total
        d_hidden = (d_logits @ p["out"].T) * (1 - hidden * hidden)
        by_pair = d_hidden.reshape(CLASSES, CLASSES, HIDDEN)
        d_l, d_r = by_pair.sum(1), by_pair.sum(0)
        g = {"left": d_l @ p["in_l"].T, "right": d_r @ p["in_r"].T, "in_l": p["left"].T @ d_l, "in_r": p["right"].T @ d_r, "bias_h": d_hidden.sum(0), "out": hidden.T @ d_logits, "bias_o": d_logits.sum(0)}
        for k in p:
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.01 * (g[k] ** 2 - v[k])
            p[k] -= rate * (1 - step / (epochs + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-9)
    return forward(p)[1].reshape(CLASSES, CLASSES, CLASSES)


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Train on all of ``docs``: the commonest words (ties by the alphabet), every triple and every other word are counted over whole texts."""
    counts = cut(word_counts(docs, text_col), "word-counts")
    common = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(COMMON).collect()]
    rest = counts.where(~F.col("word").isin(common)) if common else counts
    words = cut(rest.groupBy(F.xxhash64("word").alias("h")).agg(F.sum("n").alias("n")), "word-table")
    totals = np.zeros(HASHED, np.int64)
    for r in words.groupBy(F.pmod("h", F.lit(HASHED)).alias("at")).agg(F.sum("n").alias("n")).collect():
        totals[r["at"]] = r["n"]
    size = F.floor(8 * F.log2("n"))
    least, held = None, 0
    for r in words.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():  # some hundred sizes
        held += r["count"]
        if held > LISTED:
            break
        least = r["size"]
    top = (words.limit(0) if least is None else words.where(size >= least)).toArrow()  # LISTED words at most
    listed, times = top.column("h").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(listed)
    others = words.where((F.col("n") > 1) & (F.lit(True) if least is None else size < least))
    got = triple_counts(docs, common, text_col).toArrow().to_pandas(self_destruct=True)  # WINDOW x CLASSES cubed rows at most
    tables, alone = [], np.ones(CLASSES)
    for d in range(1, WINDOW + 1):
        mine = got[got["distance"] == d]
        triple, n = mine["triple"].to_numpy(np.int64), mine["n"].to_numpy(np.float32)
        tables.append(train(triple, n))
        if d == 1:
            alone += np.bincount(triple % CLASSES, n, CLASSES)
    alone[0] = 1
    return Model(common, tables, np.log(alone / alone.sum()).astype(np.float32), totals, listed[order], times[order], others)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, log_likelihood, per_word)`` for every row, whole texts.

    Null and empty texts have no words, a log-likelihood of 0 and a null
    ``per_word``. Repeated rows and ties score alike; other columns are ignored.
    A word that the corpus of the model doesn't hold counts as one that occurs once.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["id", "n_words", "likelihood", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(model.common)
        for b in batches:
            rows = [classes.read(t) for t in b.column(1).to_pylist()]
            n = np.array([len(c) - 2 * WINDOW for c, _ in rows], np.int64)
            whole = np.concatenate([np.zeros(0, np.int64), *[c for c, _ in rows]])
            ends = np.cumsum(n)
            at = np.repeat(np.cumsum(n + 2 * WINDOW) - n - WINDOW - ends + n, n) + np.arange(n.sum())
            sums = np.concatenate([[0.0], np.cumsum(model.class_scores(whole, at))])
            h = np.concatenate([np.zeros(0, np.int64), *[x for _, x in rows]])
            owner = np.repeat(np.arange(len(rows)), [len(x) for _, x in rows])
            known = np.zeros(len(h), bool)
            inside = np.zeros(len(rows))
            if len(model.listed):
                i = np.minimum(np.searchsorted(model.listed, h), len(model.listed) - 1)
                known = model.listed[i] == h
                share = np.log(model.times[i[known]] / model.totals[h[known] % HASHED])
                inside = np.bincount(owner[known], share, len(rows))
            left = np.concatenate([[0], np.cumsum(np.bincount(owner[~known], minlength=len(rows)))]).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(left), pa.array(h[~known]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(sums[ends] - sums[ends - n] + inside), rare], names)

    scored = src.mapInArrow(run, f"{fields(src, 'id')}, n_words long, likelihood double, rare array<long>")
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()), "scored")  # the key is written, so it stays
    words = scored.select("row", F.explode("rare").alias("h"))
    words = words.withColumn("n", F.lit(None).cast("long")) if model.words is None else words.join(model.words, "h", "left")
    total = F.element_at(F.array(*[F.lit(int(t)) for t in model.totals]), F.pmod("h", F.lit(HASHED)).cast("int") + 1)
    n = F.coalesce("n", F.lit(1)).cast("long")
    inside = words.groupBy("row").agg(F.sum(F.log(n / F.greatest(total, n))).alias("inside"))
    got = scored.select("row", "id", "n_words", "likelihood").join(inside, "row", "left")
    likelihood = F.col("likelihood") + F.coalesce("inside", F.lit(0.0))
    return got.select("id", "n_words", likelihood.alias("log_likelihood"), F.when(F.col("n_words") > 0, likelihood / F.col("n_words")).alias("per_word"))
