"""Edit-aware token counts: segment trees over pre-tokens.

A document's pre-tokens are leaves; every inner node holds the characters and
tokens below it. An edit descends by characters to the leaves that it touches;
those, and as much context as the pre-tokeniser's look-around can see, are
pre-tokenised and encoded again, until a new boundary falls on an old one; only
the sums on the way up change. The tree is a treap of runs of leaves, so that
splitting and joining cost a logarithm.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from random import Random

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import fields, small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokeniser's pattern, as the vocabulary's description gives it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters after a pre-token's end that its match can depend on ('re and 'll look two ahead).
LOOK = 3
RUN = 64
MEMO = 400_000
_LOADED: dict[bytes, Counter] = {}


class Counter:
    """Tokens of a pre-token, with a bounded memo."""

    def __init__(self, vocabulary: bytes) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(PATTERN).findall
        self.match = regex.compile(PATTERN).match
        self.memo: dict[str, int] = {}

    def sizes(self, pieces: list[str]) -> list[int]:
        memo = self.memo
        new = [p for p in set(pieces) if p not in memo]
        if new:
            if len(memo) + len(new) > MEMO:
                memo.clear()
                new = list(set(pieces))
            memo.update(zip(new, map(len, map(self.encoding.encode_ordinary, new))))
        return list(map(memo.__getitem__, pieces))


def load(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def counter(vocabulary: bytes) -> Counter:
    """One counter for each vocabulary and Python process."""
    if vocabulary not in _LOADED:
        _LOADED[vocabulary] = Counter(vocabulary)
    return _LOADED[vocabulary]


@dataclass(slots=True)
class Node:
    """A run of leaves: their lengths in characters and tokens; sums of the subtree."""

    chars: list[int]
    tokens: list[int]
    heap: float
    left: Node | None = None
    right: Node | None = None
    all_chars: int = 0
    all_tokens: int = 0
    all_leaves: int = 0

    def sum_up(self) -> Node:
        kids = [k for k in (self.left, self.right) if k]
        self.all_chars = sum(self.chars) + sum(k.all_chars for k in kids)
        self.all_tokens = sum(self.tokens) + sum(k.all_tokens for k in kids)
        self.all_leaves = len(self.chars) + sum(k.all_leaves for k in kids)
        return self


def join(a: Node | None, b: Node | None) -> Node | None:
    if a is None or b is None:
        return a or b
    if a.heap > b.heap:
        a.right = join(a.right, b)
        return a.sum_up()
    b.left = join(a, b.left)
    return b.sum_up()


def split(t: Node | None, leaves: int, rng: Random) -> tuple[Node | None, Node | None]:
    """The first ``leaves`` leaves and the rest."""
    if t is None:
        return None, None
    before = t.left.all_leaves if t.left else 0
    if leaves <= before:
        a, t.left = split(t.left, leaves, rng)
        return a, t.sum_up()
    inside = leaves - before
    if inside >= len(t.chars):
        t.right, b = split(t.right, inside - len(t.chars), rng)
        return t.sum_up(), b
    rest = Node(t.chars[inside:], t.tokens[inside:], rng.random()).sum_up()
    b = join(rest, t.right)
    t.chars, t.tokens, t.right = t.chars[:inside], t.tokens[:inside], None
    return t.sum_up(), b


def leaf_at(t: Node | None, char: int) -> tuple[int, int]:
    """(index, first character) of the leaf that holds a character; past the end: (number of leaves, length)."""
    index = start = 0
    while t:
        left = t.left.all_chars if t.left else 0
        if char < start + left:
            t = t.left
            continue
        start += left
        index += t.left.all_leaves if t.left else 0
        for n in t.chars:
            if char < start + n:
                return index, start
            start, index = start + n, index + 1
        t = t.right
    return index, start


class Document:
    """A text whose token count stays right under edits."""

    def __init__(self, text: str, c: Counter) -> None:
        self.counter, self.text, self.rng = c, text, Random(len(text))
        self.encoded = 0
        self.tree = self._grow(c.cut(text))

    def _grow(self, pieces: list[str]) -> Node | None:
        """A treap of the pieces' runs, built in one pass from left to right."""
        chars, tokens = list(map(len, pieces)), self.counter.sizes(pieces)
        self.encoded += len(pieces)
        spine: list[Node] = []
        for i in range(0, len(pieces), RUN):
            node = Node(chars[i : i + RUN], tokens[i : i + RUN], self.rng.random())
            last = None
            while spine and spine[-1].heap < node.heap:
                last = spine.pop().sum_up()
            node.left = last
            if spine:
                spine[-1].right = node
            spine.append(node)
        root = None
        while spine:
            root = spine.pop().sum_up()
        return root

    @property
    def tokens(self) -> int:
        return self.tree.all_tokens if self.tree else 0

    @property
    def leaves(self) -> int:
        return self.tree.all_leaves if self.tree else 0

    def edit(self, start: int, end: int, new: str) -> int:
        """Put ``new`` in place of characters ``start`` to ``end``; returns how many pre-tokens were encoded again."""
        start = max(0, min(start, len(self.text)))
        end = max(start, min(end, len(self.text)))
        # The first leaf whose match could see the edit; a boundary before it is certain.
        first, at = leaf_at(self.tree, max(0, start - LOOK))
        if start == 0 or first == self.leaves:
            first, at = leaf_at(self.tree, max(0, min(start, len(self.text)) - LOOK - 1))
        self.text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        pieces: list[str] = []
        pos, last = at, None
        while pos < len(self.text):
            m = self.counter.match(self.text, pos)
            pieces.append(m.group())
            pos = m.end()
            if pos >= start + len(new):
                old, old_at = leaf_at(self.tree, pos - shift)
                if old_at == pos - shift and pos - shift >= end:
                    last = old
                    break
        left, rest = split(self.tree, first, self.rng)
        _, right = split(rest, (self.leaves_of(rest) if last is None else last - first), self.rng)
        before = self.encoded
        self.tree = join(join(left, self._grow(pieces)), right)
        return self.encoded - before

    @staticmethod
    def leaves_of(t: Node | None) -> int:
        return t.all_leaves if t else 0


def edits_of(n_chars: int) -> list[tuple[int, int, str]]:
    """The query's edits: an insertion at a quarter, a deletion at a half, a replacement at three quarters, an end."""
    return [(n_chars // 4, n_chars // 4, " edited"), (n_chars // 2, n_chars // 2 + 9, ""), (3 * n_chars // 4, 3 * n_chars // 4 + 5, "'re 42"), (n_chars + 3, n_chars + 3, "\n\nend")]


def count(docs: DataFrame, vocabulary: bytes, id_col: str = "doc_id", text_col: str = "text", edits=edits_of) -> DataFrame:  # noqa: ANN001
    """``(id, n_pretokens, n_tokens, edited_tokens, reencoded)`` for every row.

    ``edits`` gives a text's edits (start, end, new text), in order, from its
    number of characters, positions being those of the text as edited so far;
    ``reencoded`` is how many pre-tokens they made anew. Null texts count as
    empty ones, which have no tokens. Repeated rows give repeated rows; other
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["n_pretokens", "n_tokens", "edited_tokens", "reencoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                d = Document(text or "", c)
                n_pretokens, n_tokens = d.leaves, d.tokens
                anew = sum(d.edit(*e) for e in edits(len(text or "")))
                rows.append((n_pretokens, n_tokens, d.tokens, anew))
            got = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[:, i]) for i in range(4))], ["id", *names])

    return src.mapInArrow(run, f"{fields(src, 'id')}, {', '.join(f'{n} long' for n in names)}")
