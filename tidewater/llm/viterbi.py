"""SentencePiece encoding by a streaming Viterbi search, and decoding.

``stream`` is the search. It takes characters in chunks and relaxes one start
after another along the trie of pieces, so it looks no further ahead than the
longest piece. When all back pointers of boundaries that pieces to come can
start at run through one boundary, the ids before it are committed and the
window starts anew there. It tests that when the window has doubled since the
last test in vain, so the work is linear in the text, whatever it holds. Ties
go to the shorter last piece: then the paths of a run of one character mostly
meet at the multiples of a piece, and the window stays some pieces long. Where
the best beginning of a run hangs on its length (an odd sign joined to the mark
in front of it), its paths do not meet before its end; the window then holds
two numbers for each character of that run, since nothing less can be right.

A boundary that no piece spans is such a meeting for certain. In most
vocabularies that is so before a word mark that another character precedes;
stretches between those recur, so what the search gave for short ones is kept in
a bounded memo. Whether it is so is looked up in the pieces: where one has a mark
after another character, texts are not cut at marks.

Scores are the vocabulary's own. Characters outside it cost ten less than the
lowest score and decompose into byte pieces, which have no other use; so does
the word mark itself where a text holds it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import md5
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import fields, small_batches

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
MEMO = 400_000
#: Longer segments are not kept in the memo.
MEMO_CHARS = 48
#: Characters that the search gets at a time, and that ``encode`` marks and splits at a time.
CHUNK = 1024
BLOCK = 65_536
NEVER = float("-inf")
#: What a Python worker keeps from task to task.
_LOADED: dict[tuple, Pieces] = {}


class Memo(dict):
    """Ids by segment; a segment that isn't there is encoded, and kept if it is short."""

    def __init__(self, v: Pieces) -> None:
        super().__init__()
        self.v = v

    def __missing__(self, segment: str) -> tuple[int, ...]:
        return segment_ids(segment, self.v)


@dataclass
class Pieces:
    """A vocabulary: ``ids`` and ``score`` of ordinary pieces, ``byte_ids`` of the 256 byte pieces, ``surface`` by id."""

    ids: dict[str, int]
    score: dict[str, float]
    byte_ids: list[int]
    surface: list[bytes | None]
    longest: int
    unknown: float
    memo: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)
    trie: dict = field(default_factory=dict)
    inside: set[tuple[str, str]] = field(default_factory=set)
    newline_inside: bool = False
    mark_inside: bool = False
    keep: int = MEMO
    digest: str = ""

    def __post_init__(self) -> None:
        """The trie maps a character to (score of the piece that ends here or None, children)."""
        self.memo = Memo(self)
        self.inside = {pair for piece in self.ids for pair in zip(piece, piece[1:])}
        self.newline_inside = any("\n" in pair for pair in self.inside)
        self.mark_inside = any(b == MARK != a for a, b in self.inside)
        self.digest = self.digest or md5(repr((sorted(self.ids.items()), sorted(self.score.items()), self.byte_ids)).encode()).hexdigest()
        for piece, score in sorted(self.score.items()):
            children = self.trie
            for c in piece[:-1]:
                children = children.setdefault(c, (None, {}))[1]
            children[piece[-1]] = (score, children.get(piece[-1], (None, {}))[1])

    @classmethod
    def load(cls, path: str = MODEL, keep: int = MEMO) -> Pieces:
        """The vocabulary of a model file; ``keep``: segments that a worker remembers at most."""
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, score, bytes_, surface = {}, {}, [0] * 256, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                bytes_[int(piece[3:5], 16)] = i
                surface.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                surface.append(None)
            else:
                ids[piece], score[piece] = i, sp.get_score(i)
                surface.append(piece.replace(MARK, " ").encode())
        return cls(ids, score, bytes_, surface, max(map(len, ids)), min(score.values()) - UNKNOWN_PENALTY, keep=keep)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}, "trie": {}, "inside": set()}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        key = (self.digest, self.keep)
        if key not in _LOADED:
            self.__post_init__()
            _LOADED[key] = self
        self.__dict__ |= {k: getattr(_LOADED[key], k) for k in ("memo", "trie", "inside")}


def stream(chunks: Iterable[str], v: Pieces) -> Iterator[int]:
    """Ids of a stream of characters, given out as soon as no later character can change them; ties go to the shorter last piece."""
    window, at, test = "", 0, 2 * v.longest  # at: the next start; test: where to look whether the paths have met
    best, back = [0.0], [0]  # for each boundary of the window: the score that leads there and where its last piece began
    trie, unknown, longest, nothing = v.trie, v.unknown, v.longest, (None, None)
    for chunk in chain(chunks, (None,)):
        if chunk is not None:
            window += chunk
            best += [NEVER] * len(chunk)
            back += [0] * len(chunk)
        size = len(window)
        stop = size if chunk is None else size - longest + 1
        while at < stop:
            so_far, end = best[at], at + 1
            s, children = trie.get(window[at], nothing)
            if s is None:  # no piece of its own
                s = unknown
            if so_far + s >= best[end]:
                best[end], back[end] = so_far + s, at
            while children and end < size:
                got = children.get(window[end])
                if got is None:
                    break
                s, children = got
                end += 1
                if s is not None and so_far + s >= best[end]:
                    best[end], back[end] = so_far + s, at
            at += 1
            if at >= test:
                if met := _meeting(best, back, at, min(at + longest, len(best))):
                    yield from _path(window, back, met, v)
                    window, shift = window[met:], best[met]
                    best = [s - shift for s in best[met:]]
                    back = [0, *(b - met for b in back[met + 1 :])]
                    at, stop, size = at - met, stop - met, size - met
                    test = max(at, longest) + longest
                else:
                    test *= 2
    yield from _path(window, back, len(window), v)


def _meeting(best: list[float], back: list[int], start: int, end: int) -> int:
    """The last boundary through which the paths to all reached boundaries from ``start`` on go; 0: they meet nowhere else."""
    alive = {i for i in range(start, end) if best[i] > NEVER}
    while len(alive) > 1:
        last = max(alive)
        alive.discard(last)
        alive.add(back[last])
    return alive.pop()


def chunked(text: str) -> Iterator[str]:
    return (text[i : i + CHUNK] for i in range(0, len(text), CHUNK))


def _path(window: str, back: list[int], end: int, v: Pieces) -> list[int]:
    out: list[int] = []
    while end:
        start = back[end]
        piece = window[start:end]
        got = v.ids.get(piece)
        if got is None:
            out.extend(reversed([v.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]))
        else:
            out.append(got)
        end = start
    return out[::-1]


def segment_ids(segment: str, v: Pieces) -> tuple[int, ...]:
    """Ids of a segment; cut where two neighbours stand together in no piece, for there all paths meet."""
    got = v.memo.get(segment)
    if got is not None:
        return got
    inside = v.inside
    cuts = [i for i, pair in enumerate(zip(segment, segment[1:]), 1) if pair not in inside]
    out: list[int] = []
    for start, end in zip([0, *cuts], [*cuts, len(segment)]):
        part = segment[start:end]
        got = v.memo.get(part)
        if got is None:
            got = tuple(stream(chunked(part), v))
            if len(part) <= MEMO_CHARS:
                if len(v.memo) >= v.keep:
                    v.memo.clear()
                v.memo[part] = got
        out += got
    if len(segment) <= MEMO_CHARS:
        v.memo[segment] = tuple(out)
    return tuple(out)


def blocks(text: str) -> Iterator[str]:
    """A text in blocks that begin where a run of spaces does, so that no piece spans two; what has no space is one block."""
    start = 0
    while len(text) - start > BLOCK:
        end = text.find(" ", start + BLOCK)
        while end > 0 and text[end - 1] == " ":
            end = text.find(" ", end + 1)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:]


def encode(text: str | None, v: Pieces) -> list[int]:
    """Ids of a text as the model's normaliser takes it: a mark in front, spaces as marks, nothing removed. Null and empty: none."""
    if not text:
        return []
    out: list[int] = []
    for i, part in enumerate(text.split(MARK)):
        if i:  # the mark itself, which the vocabulary takes for a space
            out += [v.byte_ids[b] for b in MARK.encode()]
        for j, block in enumerate([part] if v.mark_inside else blocks(part)):
            out += _encode_block(block, v, not i and not j)
    return out


def _encode_block(text: str, v: Pieces, first: bool) -> list[int]:
    marked = MARK * first + text.replace(" ", MARK)
    if v.mark_inside:
        return list(segment_ids(marked, v))
    # A mark between two other characters starts a segment; runs of marks stay together.
    apart = marked.replace(MARK, " " + MARK)
    while f"{MARK} {MARK}" in apart:
        apart = apart.replace(f"{MARK} {MARK}", MARK * 2)
    if "\n" in apart and not v.newline_inside:
        apart = apart.replace("\n", " \n ")
    return list(chain.from_iterable(map(v.memo.__getitem__, apart.split(" "))))


def decode(ids: list[int], v: Pieces) -> str:
    """The text of ids; the mark in front goes. Ids outside the vocabulary and control ids give nothing."""
    got = b"".join(v.surface[i] or b"" for i in ids if 0 <= i < len(v.surface)).decode("utf-8", "replace")
    return got[1:] if got.startswith(" ") else got


def encode_table(docs: DataFrame, v: Pieces, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``(id, n_ids, ids_digest, round_trip[, ids])`` for every row, whole texts.

    ``ids_digest`` is the MD5 of the ids as little-endian 32-bit integers;
    ``round_trip`` tells whether decoding gives the text back. Null and empty
    texts have no ids and round-trip; repeated rows give repeated rows. Other
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["id", "n_ids", "ids_digest", "round_trip", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                ids = encode(text, v)
                flat = np.array(ids, np.int32)
                rows.append((len(ids), md5(flat.tobytes()).hexdigest(), decode(ids, v) == (text or ""), flat))
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            out = [b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.bool_())]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(cols[0])]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *cols[3]]))))
            yield pa.RecordBatch.from_arrays(out, names)

    schema = f"{fields(src, 'id')}, n_ids long, ids_digest string, round_trip boolean" + ", ids array<int>" * with_ids
    return src.mapInArrow(run, schema)
