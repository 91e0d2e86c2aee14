"""Vocabularies beside each other, pieces across marks, broken sound files, the blocks of decontamination."""

from __future__ import annotations

import io
import math
import pickle
import random
import time
import wave
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.llm import chroma, decontam, queries, simhash, toxicity, viterbi


def vocabulary(pieces, first=0):
    ids = {p: first + i for i, p in enumerate(pieces)}
    return viterbi.Pieces(ids, {p: -1.0 * len(pieces) + len(p) ** 2 for p in pieces}, list(range(1000, 1256)), [p.encode() for p in pieces], max(map(len, pieces)), -99.0)


def test_two_vocabularies_of_one_shape_stay_apart():
    one, two = vocabulary(["▁", "a", "b", "ab"]), vocabulary(["▁", "c", "d", "cd"])
    assert (len(one.ids), one.longest, one.unknown) == (len(two.ids), two.longest, two.unknown)
    a, b = pickle.loads(pickle.dumps(one)), pickle.loads(pickle.dumps(two))
    assert viterbi.encode("ab", a) == viterbi.encode("ab", one) == [0, 3]
    assert viterbi.encode("cd", b) == viterbi.encode("cd", two) == [0, 3]
    assert viterbi.encode("cd", a) == [0, 1099, 1100]
    again = pickle.loads(pickle.dumps(a))
    assert again.trie is a.trie  # one vocabulary is one in a worker


ACROSS = vocabulary(["▁", "a", "b", "a▁b", "▁▁a", "b▁▁", "ab"])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab ", max_size=40))
def test_pieces_may_span_marks(text):
    marked = viterbi.MARK + text.replace(" ", viterbi.MARK)
    got = viterbi.encode(text, ACROSS)
    assert got == (list(viterbi.stream(iter(marked), ACROSS)) if text else [])
    best = [0.0] + [-np.inf] * len(marked)
    for end in range(1, len(marked) + 1):
        for i in range(max(0, end - ACROSS.longest), end):
            s = ACROSS.score.get(marked[i:end], ACROSS.unknown if i == end - 1 else None)
            if s is not None:
                best[end] = max(best[end], best[i] + s)
    by_id = {i: ACROSS.score[p] for p, i in ACROSS.ids.items()}
    assert not text or sum(by_id[i] for i in got) == pytest.approx(best[-1])


def test_long_text_with_pieces_across_marks():
    text = "a b " * 40_000
    assert viterbi.encode(text, ACROSS) == list(viterbi.stream(viterbi.chunked(viterbi.MARK + text.replace(" ", viterbi.MARK)), ACROSS))


# -- sound ------------------------------------------------------------------------


def test_broken_headers_give_no_items_and_raise_nothing():
    rng = random.Random(3)
    good = bytearray(chroma.encode_wav(np.sin(np.arange(9000) / 5)))
    for _ in range(3000):
        bad = bytearray(good)
        for _ in range(2):
            bad[rng.randrange(44)] = rng.randrange(256)
        x = chroma.decode_wav(bytes(bad))
        assert x.ndim == 1 and len(x) <= 18_100 * 4


@pytest.mark.parametrize("bits", [40, 48, 64])
def test_wider_samples_give_none(bits):
    good = bytearray(chroma.encode_wav(np.sin(np.arange(4000) / 5)))
    good[34:36] = bits.to_bytes(2, "little")
    good[32:34] = (bits // 8).to_bytes(2, "little")
    assert len(chroma.decode_wav(bytes(good))) == 0


@pytest.mark.parametrize("rate", [1, 999, 2_000_000_000])
def test_rates_that_are_no_sound(rate):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 2, rate, 0, "NONE", ""))
        w.writeframes(bytes(8000))
    assert len(chroma.decode_wav(out.getvalue())) == 0


def test_broken_files_in_a_table(spark):
    rows = [(1, b"RIFF"), (2, None), (3, chroma.encode_wav(np.sin(np.arange(40_000) / 5)))]
    got = {r["id"]: len(r["items"]) for r in chroma.fingerprints(spark.createDataFrame(rows, "id long, audio binary")).collect()}
    assert got[1] == got[2] == 0 < got[3]


# -- decontamination --------------------------------------------------------------


def test_blocks_pair_few_windows(spark, monkeypatch):
    """Of all windows and items of one length less than a tenth are candidates; the tables' own documents."""
    folder = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    seen = {}
    real = decontam.candidates

    def counted(starts, windows, known):
        out = real(starts, windows, known)
        seen.update(pairs=out.select("id", "uid", "start").distinct().count(), seeded=starts.count())
        return out

    monkeypatch.setattr(decontam, "candidates", counted)
    found = decontam.matches(docs, items).count()
    n_words = [r[0] for r in docs.select(F.size(decontam.plain_words(F.col("text")))).collect()]
    lengths = [r["len"] for r in decontam.item_words(items).collect()]
    every = sum(max(n - k + 1, 0) for k in lengths for n in n_words)
    assert 0 < found <= seen["pairs"] <= seen["seeded"] and seen["pairs"] < every / 10_000


def test_rows_without_id_are_judged_by_their_text(spark):
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    passage = words(30)
    rows = [(None, passage, "x"), (None, words(40), "x"), (1, passage, "x"), (2, words(40), "x"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __leak string")
    kept = decontam.decontaminate(docs, spark.createDataFrame([(7, passage)], "item_id long, text string"))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None) for r in kept.collect()) == [(False, 2, False), (True, 0, False), (True, 0, True)]
    assert kept.columns == docs.columns


# -- sets of shingles -------------------------------------------------------------


@pytest.mark.parametrize("few", [0, 32, 10**9])
def test_sets_in_bulk_are_sets_one_by_one(monkeypatch, few):
    """Links connect what pairs of similar sets connect, however they are counted; empty sets among them."""
    monkeypatch.setattr(simhash, "FEW_PAIRS", few)
    monkeypatch.setattr(simhash, "COLUMNS", 50)
    rng = np.random.default_rng(few % 7)
    base = [np.unique(rng.integers(0, 1 << 40, 60).astype(np.uint64)) for _ in range(12)]
    sets = [np.zeros(0, np.uint64)] * 2
    for i in range(300):
        x = base[i % 12]
        keep = x[rng.random(len(x)) > rng.choice([0.02, 0.1, 0.2])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 40, rng.integers(0, 6)).astype(np.uint64)])))
    fps = np.array([simhash.fingerprint(x, simhash.WIDE) for x in sets])
    order = np.argsort(np.bitwise_count(fps).sum(1), kind="stable")
    sets, fps = [sets[i] for i in order], fps[order]
    sizes = np.array([len(x) for x in sets])
    found = simhash.links_in(np.zeros(len(sets), np.int64), fps, 256, tile=40, sizes=sizes, sets=sets)

    def groups(pairs):
        root = list(range(len(sets)))

        def top(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs:
            root[max(top(a), top(b))] = min(top(a), top(b))
        return [top(i) for i in range(len(sets))]

    every = [(i, j) for i in range(len(sets)) for j in range(i) if simhash.similar(sets[i], sets[j])]
    assert groups(found) == groups(every) and len(set(groups(every))) < len(sets)
    assert all(simhash.similar(sets[a], sets[b]) for a, b in found)


def test_many_sets_that_are_nearly_similar_are_quick():
    """2,000 sets pairwise 0.7 alike, two million pairs that fail: seconds."""
    rng = np.random.default_rng(1)
    core = np.unique(rng.integers(0, 1 << 50, 82).astype(np.uint64))
    sets = [np.unique(np.concatenate([core, rng.integers(0, 1 << 50, 17).astype(np.uint64)])) for _ in range(2000)]
    fps = np.array([simhash.fingerprint(x, simhash.WIDE) for x in sets])
    order = np.argsort(np.bitwise_count(fps).sum(1), kind="stable")
    began = time.perf_counter()
    found = simhash.links_in(np.zeros(len(sets), np.int64), fps[order], simhash.WIDE_RADIUS, sizes=np.full(2000, 99), sets=[sets[i] for i in order])
    took = time.perf_counter() - began
    print(f"{took:.1f} s")
    assert found == [] and took < 20


# -- toxicity ---------------------------------------------------------------------


def slow_score(text, model):
    """A text's score, subword by subword and window by window."""

    def margin(word):
        marked = f"<{''.join(c for c in word if c.isalnum())}>"
        found = [zlib.crc32(marked.encode("utf-8", "surrogatepass")) % toxicity.BUCKETS]
        for n in range(toxicity.GRAMS[0], toxicity.GRAMS[1] + 1):
            for i in range(len(marked) - n + 1):
                x = ord(marked[i])
                for c in marked[i + 1 : i + n]:
                    x = (x * 0x9E3779B97F4A7C15 + ord(c)) % (1 << 64)
                x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) % (1 << 64)
                found.append((x >> 40) % toxicity.BUCKETS)
        return sum(model.margin[b] for b in found) / len(found)

    words = (text or "").lower().split()
    words = [w for i, w in enumerate(words) if not i or words[i - 1] != w]
    each = [margin(w) for w in words]
    size = toxicity.WINDOW
    windows = [sum(each[i : i + size]) / size for i in range(max(1, len(each) - size + 1))] if each else [0.0]
    return 1 / (1 + math.exp(-(max(windows) + model.bias)))


def test_toxicity_against_brute_force():
    rng = np.random.default_rng(5)
    model = toxicity.Model(rng.normal(0, 3, toxicity.BUCKETS), -0.7)
    pick = random.Random(2)
    texts = [None, "", "  ", "a", "Same same SAME word", "ß Straße 漢字 😀 !!!", " ".join(pick.choices(["the", "worthless", "x-y", "İ", "1,000"], k=70))]
    texts += [" ".join("".join(pick.choices("abcdé!", k=pick.randint(1, 9))) for _ in range(pick.randint(1, 40))) for _ in range(60)]
    assert model.scorer().scores(texts) == pytest.approx([slow_score(t, model) for t in texts], abs=1e-9)


def test_toxicity_on_rows_held_out(spark):
    """Labels that were never learned, whole tables."""
    got = queries.op9_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic"), "doc_id").where("toxic IS NOT NULL")
    n = got.agg(F.count_if(F.expr("toxic = 1 AND predicted = 1")).alias("tp"), F.count_if(F.expr("toxic = 0 AND predicted = 1")).alias("fp"), F.count_if(F.expr("toxic = 1")).alias("all")).first()
    print(f"precision {n['tp'] / (n['tp'] + n['fp']):.2f}, recall {n['tp'] / n['all']:.2f} of {n['all']}")
    assert n["tp"] >= 0.85 * (n["tp"] + n["fp"]) and n["tp"] >= 0.7 * n["all"] and n["all"] > 50
