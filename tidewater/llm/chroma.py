"""Chroma audio fingerprints and the alignment of recordings.

Frames of pitch-class energy form an image; sixteen filters compare sums of its
rectangles, taken from an integral image, and quantise each comparison to two
bits of a Gray code; the 32 bits of a frame are an item. Two recordings are
aligned by the offset at which most of their items are equal, and judged by the
bits in which their items differ at that offset.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import cut, fields, salted_join, small_batches

RATE = 4000
#: Sampling rates that are taken for sound; what a broken header claims beyond would ask for any amount of memory.
RATES = (1000, 768_000)
FRAME, HOP = 1024, 512
LOW_HZ, HIGH_HZ = 100.0, 1800.0
WIDEST = 8
#: (kind, first pitch class, classes, frames): kinds compare a rectangle with the one six classes on, its halves above and below, its halves before and after, its quarters crosswise.
FILTERS = [
    *[(0, p, 2, 8) for p in (0, 3)],
    *[(1, p, 2, 8) for p in (1, 4, 7, 10)],
    *[(1, p, 6, 8) for p in (0, 3)],
    *[(2, p, 3, 8) for p in (0, 3, 6, 9)],
    *[(3, p, 4, 8) for p in (0, 3, 6, 9)],
]
#: What makes two recordings a match: equal items at the best offset, and the share of bits that differ over the overlap (0.5 for strangers).
MIN_VOTES = 4
MAX_BIT_ERROR = 0.25


def decode_wav(data: bytes | None) -> np.ndarray:
    """Mono samples in -1 to 1 of a PCM WAV file of 8, 16, 24 or 32 bits, at ``RATE`` by linear interpolation; null, empty, broken files, other codings and rates outside ``RATES``: none."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            rate, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
            # no more frames than the file has bytes for, whatever its header says
            raw = w.readframes(min(w.getnframes(), len(data) // (width * channels)))
    except (wave.Error, EOFError, RuntimeError, ValueError, ArithmeticError):  # what broken headers raise
        return np.zeros(0)
    if width > 4 or not RATES[0] <= rate <= RATES[1]:
        return np.zeros(0)
    raw = np.frombuffer(raw[: len(raw) // (width * channels) * width * channels], np.uint8).reshape(-1, width)
    if width == 1:
        x = raw[:, 0].astype(np.float64) / 128 - 1  # 8 bits have no sign
    else:
        wide = np.zeros((len(raw), 4), np.uint8)
        wide[:, 4 - width :] = raw
        x = wide.view("<i4")[:, 0] / 2.0**31
    x = x.reshape(-1, channels).mean(1) if len(x) else x
    return x if rate == RATE or not len(x) else np.interp(np.arange(int(len(x) * RATE / rate)) * rate / RATE, np.arange(len(x)), x)


def encode_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def render(notes: list[float] | None) -> np.ndarray:
    """The clip of a vector: a tone a number, half a frame each, its pitch one of 36 over three octaves; null or no numbers: silence of no length."""
    x = np.nan_to_num(np.asarray([0.0 if v is None else v for v in (notes or [])], np.float64), posinf=0, neginf=0)
    if not len(x):
        return np.zeros(0)
    pitch = np.clip(np.floor((x + 0.4) * 45), 0, 35)
    freq = np.repeat(110 * 2 ** (pitch / 12), HOP)
    return 0.5 * np.sin(2 * np.pi * np.cumsum(freq) / RATE)


def _pitch_classes() -> np.ndarray:
    freq = np.fft.rfftfreq(FRAME, 1 / RATE)
    used = (freq >= LOW_HZ) & (freq <= HIGH_HZ)
    kind = np.zeros((len(freq), 12), np.float32)
    kind[np.flatnonzero(used), np.round(12 * np.log2(freq[used] / 110)).astype(int) % 12] = 1
    return kind


_BINS = _pitch_classes()
_SHAPE = np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Pitch-class energy by frame, each frame of unit length; fewer samples than a frame: none."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[::HOP] * _SHAPE
    power = np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32) ** 2 @ _BINS
    size = np.sqrt((power**2).sum(1, keepdims=True))
    return np.where(size > 1e-3, power / np.maximum(size, 1e-9), 0.0)


def responses(image: np.ndarray) -> np.ndarray:
    """A row a filter: its comparison at each frame that the widest filter fits; fewer frames: no columns."""
    n = max(0, len(image) - WIDEST + 1)
    if not n:
        return np.zeros((len(FILTERS), 0))
    whole = np.zeros((len(image) + 1, 25))
    whole[1:, 1:] = np.cumsum(np.cumsum(np.concatenate([image, image], 1), 0), 1)  # pitch classes go round

    def box(t: int, frames: int, p: int, classes: int) -> np.ndarray:
        a, b = whole[t : t + n], whole[t + frames : t + frames + n]
        return b[:, p + classes] - b[:, p] - a[:, p + classes] + a[:, p]

    out = []
    for kind, p, classes, frames in FILTERS:
        up, half = classes // 2, frames // 2
        if kind == 0:
            x, y = box(0, frames, p, classes), box(0, frames, (p + 6) % 12, classes)
        elif kind == 1:
            x, y = box(0, frames, p, up), box(0, frames, p + up, up)
        elif kind == 2:
            x, y = box(0, half, p, classes), box(half, half, p, classes)
        else:
            x = box(0, half, p, up) + box(half, half, p + up, up)
            y = box(0, half, p + up, up) + box(half, half, p, up)
        out.append(np.log1p(np.maximum(x, 0)) - np.log1p(np.maximum(y, 0)))
    return np.array(out)


@cache
def quartiles() -> np.ndarray:
    """Three bounds a filter, learned from random melodies of a fixed seed: each level is about as common, so that strangers rarely share an item."""
    rng = np.random.default_rng(1)
    melodies = [responses(chroma(render(list(rng.uniform(-0.4, 0.4, 64))))) for _ in range(100)]
    return np.quantile(np.concatenate(melodies, 1), [0.25, 0.5, 0.75], axis=1).T


def items(image: np.ndarray) -> np.ndarray:
    """Packed items of a chroma image; fewer frames than the widest filter: none."""
    got = responses(image)
    out = np.zeros(got.shape[1], np.uint32)
    for row, bounds in zip(got, quartiles()):
        level = np.searchsorted(bounds, row).astype(np.uint32)
        out = out << np.uint32(2) | level ^ (level >> np.uint32(1))
    return out


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int] | None:
    """(offset, votes, overlap, differing bits) of two recordings' items, b's position less a's; ties go to the smallest offset by size, then value. No equal items: None."""
    at = np.argwhere(a[:, None] == b[None, :])
    if not len(at):
        return None
    offsets, votes = np.unique(at[:, 1] - at[:, 0], return_counts=True)
    best = min(range(len(offsets)), key=lambda i: (-votes[i], abs(offsets[i]), offsets[i]))
    o = int(offsets[best])
    x, y = a[max(0, -o) :], b[max(0, o) :]
    n = min(len(x), len(y))
    return o, int(votes[best]), n, int(np.bitwise_count(x[:n] ^ y[:n]).sum())


def fingerprints(media: DataFrame, decode: Callable[..., np.ndarray] = decode_wav, id_col: str = "id", media_col: str = "audio") -> DataFrame:
    """``(id, items array<long>)`` for every row; what ``decode`` makes silent or shorter than the widest filter has no items."""
    small_batches(media.sparkSession)
    src = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [items(chroma(decode(x))).astype(np.int64).tolist() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int64()))], ["id", "items"])

    return src.mapInArrow(run, f"{fields(src, 'id')}, items array<long>")


def differing(a: Column, b: Column, offset: Column) -> Column:
    """(overlap, bits) as a struct: of two arrays of items, b's position less a's being ``offset``."""
    n = F.least(F.size(a) - F.greatest(-offset, F.lit(0)), F.size(b) - F.greatest(offset, F.lit(0)))
    x = F.slice(a, F.greatest(-offset, F.lit(0)) + 1, n)
    y = F.slice(b, F.greatest(offset, F.lit(0)) + 1, n)
    bits = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    return F.struct(n.alias("overlap"), bits.alias("bits"))


def search(prints: DataFrame, every: int = 50) -> DataFrame:
    """Align recordings whose id is divisible by ``every`` with all others.

    Recordings of equal items form a class, named by its smallest id; the result
    has a row for each recording (``id, class_id, n_items``, the rest null) and,
    between class representatives, a row for each class and query class that
    match: ``query_class, offset, votes, overlap, bit_error``. A class is a query
    if it holds a query id. Recordings without items are of one class that
    matches nothing; rows with a null id belong to a class but never name it
    unless it has no other. Equal rows give equal rows. Every shared item votes:
    none is left out for being common.
    """
    prints = cut(prints.select("id", "items", F.xxhash64("items").alias("print")), "prints")
    classes = prints.groupBy("print").agg(F.min("id").alias("class_id"), F.first("items").alias("items"), F.max(F.coalesce(F.col("id") % every == 0, F.lit(False))).alias("query"))
    classes = cut(classes, "print-classes")
    member = salted_join(prints.select("id", "print", F.size("items").cast("long").alias("n_items")), classes.select("print", "class_id"), "print").drop("print")
    rows = classes.select("class_id", "print", "query", F.posexplode("items").alias("pos", "item"))
    asked = rows.where("query").select(F.col("print").alias("query_print"), F.col("pos").alias("query_pos"), "item")
    votes = rows.select("print", "pos", "item").join(asked, "item").where("print <> query_print").groupBy("print", "query_print", (F.col("pos") - F.col("query_pos")).alias("offset")).agg(F.count("*").alias("votes"))
    best = votes.groupBy("print", "query_print").agg(F.max(F.struct("votes", (-F.abs("offset")).alias("near"), (-F.col("offset")).alias("first"))).alias("b")).where(F.col("b.votes") >= MIN_VOTES)
    pairs = best.select("print", "query_print", (-F.col("b.first")).alias("offset"), F.col("b.votes").alias("votes"))
    sides = classes.select("print", "class_id", "items")
    pairs = pairs.join(sides, "print").join(sides.select(F.col("print").alias("query_print"), F.col("class_id").alias("query_class"), F.col("items").alias("query_items")), "query_print")
    pairs = pairs.withColumn("d", differing(F.col("query_items"), F.col("items"), F.col("offset"))).withColumn("bit_error", F.col("d.bits") / (32.0 * F.col("d.overlap"))).where(F.col("bit_error") <= MAX_BIT_ERROR)
    found = pairs.select(F.col("class_id").alias("id"), "class_id", F.size("items").cast("long").alias("n_items"), "query_class", F.col("offset").cast("long").alias("offset"), "votes", F.col("d.overlap").cast("long").alias("overlap"), F.round("bit_error", 6).alias("bit_error"))
    return member.select("id", "class_id", "n_items").unionByName(found, allowMissingColumns=True)
