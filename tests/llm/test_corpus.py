"""SimHash, decontamination, archives, audio, the pipeline; null, empty, long, tied, repeated and clashing inputs for all."""

from __future__ import annotations

import gzip
import io
import random
import wave
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import arc, bidilm, chroma, decontam, licences, queries, shared, simhash, tokencount, toxicity, urlfilter, viterbi

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(5)) for _ in range(400)]


def text(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# -- SimHash ----------------------------------------------------------------------


def slow_fingerprint(t):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps, radius):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_simhash_by_brute_force(spark):
    base = text(200).split()
    docs = []
    for _ in range(120):
        w = list(base)
        for _ in range(RNG.randint(0, 3)):
            w[RNG.randrange(200)] = RNG.choice(WORDS)
        docs.append(" ".join(w))
    docs += [text(RNG.randint(1, 60)) for _ in range(80)] + ["", None, " \n\t", "É one", "é one", "A b", "a B", docs[0], text(30_000)]
    rows = [(1000 + i, t, "x") for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(5)
    got = {r["id"]: r for r in simhash.near_duplicates(df).collect()}
    fps = [slow_fingerprint(t) for t in docs]
    want = slow_components(fps, 3)
    assert len(got) == len(docs)
    for i in range(len(docs)):
        assert got[1000 + i]["fingerprint"] == f"{fps[i]:016x}" and got[1000 + i]["component_id"] == 1000 + want[i]


def test_every_pair_within_the_radius_shares_a_table():
    for _ in range(2000):
        a = RNG.getrandbits(64)
        b = a
        for bit in RNG.sample(range(64), RNG.randint(0, 3)):
            b ^= 1 << bit
        assert any(a & m[0] == b & m[0] for m in simhash.tables(1, 3, 12))


def test_hot_groups_are_sliced_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 20)
    base, fps = RNG.getrandbits(64), set()
    while len(fps) < 150:
        x = base
        for bit in RNG.sample(range(20), RNG.randint(0, 4)):
            x ^= 1 << bit
        fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(simhash.signed(f), simhash.signed(f)) for f in fps], "node long, f0 long")
    roots = {r["node"]: r["root"] for r in shared.components(simhash.links(nodes, 3)).collect()}
    want = slow_components(fps, 3)
    for i in range(len(fps)):
        for j in range(i):
            assert (want[i] == want[j]) == (roots.get(simhash.signed(fps[i]), i) == roots.get(simhash.signed(fps[j]), j))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)] + [(200, 200 + i) for i in range(1, 90)]
    got = {r["node"]: r["root"] for r in shared.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[103] == 100 and all(got[200 + i] == 200 for i in range(90))
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_of_each_group(spark):
    rng = random.Random(3)
    docs, group = [], 0
    for g in range(25):
        base = text(150, rng).split()
        for c in range(4):
            w = list(base)
            for _ in range(min(c, 2)):
                w[rng.randrange(150)] = rng.choice(WORDS)
            docs.append((len(docs), " ".join(w)))
    df = spark.createDataFrame([*docs, (0, docs[0][1]), (None, docs[0][1])], "doc_id long, text string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [4 * g for g in range(25)]
    assert kept.where("doc_id is null").count() == 1


def apart(rng, n, changed):
    """Two texts of ``n`` shingles, ``changed`` of them different at the end: similarity (n - changed) / (n + changed)."""
    w = [f"w{rng.getrandbits(40)}" for _ in range(n + 4)]
    return " ".join(w), " ".join(w[: len(w) - changed] + [f"x{rng.getrandbits(40)}" for _ in range(changed)])


def test_texts_under_the_similarity_stay(spark):
    rng = random.Random(21)
    docs = [t for n in (40, 100, 300) for share in (0.5, 0.6, 0.7, 0.75, 0.79) for _ in range(6) for t in apart(rng, n, int(n * (1 - share) / (1 + share)) + 1)]
    core = [f"core{i}" for i in range(88)]  # 84 shared shingles of 102: pairwise 0.7
    docs += [" ".join(core + [f"own{i}x{j}" for j in range(18)]) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert simhash.keep_one(df).count() == len(docs)


@pytest.mark.parametrize(("key_slice", "set_slice", "common"), [(20_000, 2_000_000, 1000), (7, 900, 5)])
def test_no_similar_pair_is_missed(spark, monkeypatch, key_slice, set_slice, common):
    for name, value in (("KEY_SLICE", key_slice), ("SET_SLICE", set_slice), ("COMMON", common)):
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(22)
    docs = [t for n in (9, 18, 45, 90, 99, 180, 900) for _ in range(25) for t in apart(rng, n, n // 9)]  # 0.8 exactly, or just above
    base = [f"b{i}" for i in range(104)]
    for i in range(40):  # a group in which not all pairs are similar
        at = rng.randrange(80)
        docs.append(" ".join(base[:at] + [f"c{i}x{j}" for j in range(rng.randint(1, 14))] + base[at + rng.randint(0, 14) :]))
    docs += [" ".join(base[: 104 - i]) for i in range(0, 30, 3)] + ["", None, "a b", "b a"]
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    got = {r["id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(len(docs))}


# -- decontamination --------------------------------------------------------------


def slow_matches(docs, items):
    """Best window of any start, by the same similarity."""
    import re

    words = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
    from collections import Counter

    out = {}
    for d, t in docs:
        w = words(t)
        for i, it in items:
            v = words(it)
            need = Counter(grams(v))
            k = min(5, len(v))
            for s in range(max(1, len(w) - k + 1)):
                part = w[s : s + len(v)]
                got = Counter(tuple(part[i : i + k]) for i in range(len(part) - k + 1))
                if need and sum((got & need).values()) >= 0.8 * sum(need.values()):
                    out[d, i] = max(out.get((d, i), 0), round(sum((got & need).values()) / sum(need.values()), 6))
    return out


def test_decontamination_by_brute_force(spark):
    rng = random.Random(5)
    items = [(i, text(rng.randint(16, 50), rng)) for i in range(20)] + [(90, None), (91, ""), (92, "one two three"), (0, None)]
    docs = []
    for d in range(60):
        body = text(rng.randint(0, 120), rng).split()
        if d % 2:
            it = items[d % 20][1].split()
            if d % 3 == 0:
                it[2] = "changed"
            if d % 5 == 0:
                it = it[: len(it) // 2]
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() + "," for w in it] if d % 7 == 0 else it
        docs.append((d, " ".join(body)))
    docs += [(100, None), (101, ""), (102, "One, two: three!"), (103, items[3][1] + " x " + items[3][1])]
    df = spark.createDataFrame([(*r, "x") for r in [*docs, docs[1]]], "doc_id long, text string, item string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["id"], r["item"]): r["similarity"] for r in decontam.matches(df, bench).collect()}
    assert got == slow_matches(docs, items) and len(got) > 10
    clean = decontam.decontaminate(df, bench)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in got} and clean.columns == df.columns
    assert decontam.matches(df, bench.limit(0)).count() == decontam.matches(df.limit(0), bench).count() == 0


def test_short_items_and_repetition_by_brute_force(spark):
    rng = random.Random(33)
    items = [(1, "quick brown fox"), (2, "zebra"), (3, "alpha beta gamma delta"), (4, "one two three four five"), (5, "la " * 30), (6, "uno dos"), (6, "tres cuatro")]
    docs = [f"{text(20, rng)} the Quick, brown fox {text(20, rng)}", "zebra", f"a zebra {text(3, rng)}", "alpha beta gamma", f"x alpha beta gamma delta y {text(9, rng)}", f"{text(9, rng)} one two three four five", "one two three four", "la " * 3000, "la " * 25, "uno dos", "y tres cuatro z", "", None]
    rows = list(enumerate(docs))
    got = {(r["id"], r["item"]): r["similarity"] for r in decontam.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == slow_matches(rows, items) and {i for _, i in got} == {1, 2, 3, 4, 5, 6}


def test_random_windows_by_brute_force(spark):
    """Texts of few words, so that shingles repeat everywhere and many windows come near the threshold."""
    rng = random.Random(34)
    few = ["a", "b", "c"]
    items = [(i, " ".join(rng.choice(few) for _ in range(rng.choice([7, 12, 12, 20])))) for i in range(12)]
    docs = [(d, " ".join(rng.choice(few) for _ in range(rng.randint(0, 90)))) for d in range(60)]
    docs += [(100 + i, " ".join(w if rng.random() > 0.03 else "z" for w in t.split())) for i, t in items]
    got = {(r["id"], r["item"]): r["similarity"] for r in decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = slow_matches(docs, items)
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()} and len(want) > 12


def test_moved_parts_by_brute_force(spark):
    rng = random.Random(31)
    items = [(i, text(rng.randint(24, 90), rng)) for i in range(25)]
    docs = []
    for _, t in items:
        w = t.split()
        for cut in (len(w) // 2, len(w) // 3):
            docs.append(f"{text(100, rng)} {' '.join(w[cut:] + w[:cut])} {text(80, rng)}")
            docs.append(f"{' '.join(w[cut:])} {text(2, rng)} {' '.join(w[:cut])}")
        third = len(w) // 3
        docs.append(f"{text(40, rng)} {' '.join(w[2 * third:] + w[third:2 * third] + w[:third])} {text(10, rng)}")
    rows = list(enumerate(docs))
    got = {(r["id"], r["item"]): r["similarity"] for r in decontam.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = slow_matches(rows, items)
    assert want and got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


# -- archives ---------------------------------------------------------------------


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    recs = [("http://a/ b", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\nX: y\r\n\r\nhello\nWARC/1.1\r\n"), ("dns:a", "0.0.0.0", "2001", "text/dns", b""), ("http://b/", "::1", "x", "-", b"HTTP/1.0 204\n\n")]
    got = list(arc.parse_arc(arc.arc_bytes(recs, version)))
    assert got[0].url.startswith("filedesc:") and got[0].version == version
    assert [(r.url, r.ip, r.date, r.content_type, r.block) for r in got[1:]] == recs
    assert [r.payload for r in got[1:]] == [b"hello\nWARC/1.1\r\n", b"", b""]
    with pytest.raises(ValueError):
        list(arc.parse_arc(arc.arc_bytes(recs, version)[:-9]))


def test_archives_by_hand(spark):
    html = ["<p>é</p>", None, "", "<p>é</p>", "x\r\n\r\nWARC/1.1\r\n\r\n", "<p>é</p>", "z" * 300_000]
    rows = [(i, "http://h/%d\n" % i if i else None, h, "x") for i, h in enumerate(html)]
    got = {r["page_id"]: r for r in arc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")).collect()}
    assert len(got) == len(html)
    for i, h in enumerate(html):
        data = (h or "").encode()
        last = max(j for j, x in enumerate(html) if (x or "") == (h or ""))
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), arc.digest(data))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == last else ("revisit", last))
    assert arc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_files_hold_whole_records(spark, tmp_path):
    one = arc.arc_bytes([("http://a/", "1.1.1.1", "20200101000000", "text/html", b"HTTP/1.1 200 OK\r\n\r\n\xff\xfe raw")])
    df = spark.createDataFrame([("a.arc", one), (None, None), ("e.arc", b"")], "path string, content binary")
    recs = arc.convert(df).withColumn("refers_to", F.lit(None).cast("long"))
    assert sorted(r["record_type"] for r in recs.collect()) == ["response", "warcinfo"]
    assert recs.select("record_id").distinct().count() == 2 and sorted(map(str, recs.collect())) == sorted(map(str, recs.collect()))
    arc.write_warc(recs, f"{tmp_path}/w")
    parsed = [r for f in Path(f"{tmp_path}/w").glob("part-*") for r in arc.parse_warc(gzip.decompress(f.read_bytes()))]
    heads = {h["warc-type"]: (h, b) for h, b in parsed}
    assert heads["response"][1].endswith(b"\xff\xfe raw") and heads["response"][0]["warc-date"] == "2020-01-01T00:00:00Z"


def warc(i, block=b"x" * 10):
    return f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: {i}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_any_members_are_read_and_faults_told(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arc, "PIECE", 7)
    whole = [warc(1), warc(2, b"\r\n\r\nWARC/1.1\r\n" * 50), warc(3, b"")]
    files = {"member a record": b"".join(map(gzip.compress, whole)), "one member": gzip.compress(b"".join(whole)), "plain": b"".join(whole), "odd members": gzip.compress(b"".join(whole)[:70]) + arc.EMPTY_MEMBER + gzip.compress(b"".join(whole)[70:]) + b"\0" * 9}
    for content in files.values():
        assert [h["warc-record-id"] for h, _ in arc.parse_warc(arc.inflate(content))] == ["1", "2", "3"]
    broken = [files["member a record"][:-5], b"".join(whole)[:-9], b"no archive", warc(1) + b"WARC/1.1\r\nContent-Length: x\r\n\r\n"]
    df = spark.createDataFrame([(x,) for x in [*files.values(), *broken, b""]], "content binary")
    got = arc.read_warc(df, {"WARC-Record-ID": "i"}).collect()
    assert sum(r["i"] is not None for r in got) == 12 + 3 + 2 + 0 + 1 and sum(r["error"] is not None for r in got) == 4


def test_broken_archives_are_told(spark):
    one = arc.arc_bytes([("http://a/", "1.1.1.1", "20200101000000", "text/html", b"HTTP/1.1 200 OK\r\n\r\nx"), ("http://b/", "1.1.1.1", "20200101000000", "text/html", b"y")])
    rows = [("good.arc", one), ("good.arc.gz", gzip.compress(one)), ("short.arc", one[:-4]), ("none.arc", b"nothing"), ("empty-version.arc", b"filedesc://x 0.0.0.0 20240101000000 text/plain 2\n\n\n"), ("bad.gz", b"\x1f\x8bzz")]
    got = arc.convert(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert sum(r["error"] is None for r in got) == 3 + 3 + 2 and sorted(r["error"].split(":")[0] for r in got if r["error"]) == ["bad.gz", "empty-version.arc", "none.arc", "short.arc"]


def test_revisits_name_what_they_refer_to(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "same"), (2, "http://b/", "same"), (3, "http://c/", "other")], "page_id long, url string, html string")
    arc.write_warc(arc.refer(arc.convert(arc.pages_as_arc(pages), keep=("page_id",), version_blocks=False), "page_id"), f"{tmp_path}/w", ("page_id",))
    heads = {h["warc-x-page_id"]: h for f in Path(f"{tmp_path}/w").glob("part-*") for h, _ in arc.parse_warc(arc.inflate(f.read_bytes()))}
    assert heads["1"]["warc-type"] == "revisit" and heads["1"]["warc-refers-to"] == heads["2"]["warc-record-id"]
    assert heads["1"]["warc-refers-to-target-uri"] == "http://b/" and heads["1"]["warc-refers-to-date"] == heads["2"]["warc-date"]
    assert "warc-refers-to" not in heads["2"] and "warc-refers-to" not in heads["3"]


# -- audio ------------------------------------------------------------------------


def test_alignment_finds_the_offset():
    rng = np.random.default_rng(2)
    song = chroma.render(list(rng.normal(0, 0.2, 120)))
    cut = song[20 * chroma.HOP : 90 * chroma.HOP] + rng.normal(0, 0.01, 70 * chroma.HOP)
    a, b = chroma.items(chroma.chroma(song)), chroma.items(chroma.chroma(cut))
    offset, votes, overlap, bits = chroma.align(a, b)
    assert offset == -20 and votes >= chroma.MIN_VOTES and bits / (32 * overlap) < chroma.MAX_BIT_ERROR
    other = chroma.items(chroma.chroma(chroma.render(list(rng.normal(0, 0.2, 120)))))
    got = chroma.align(a, other)
    assert got is None or got[3] / (32 * got[2]) > chroma.MAX_BIT_ERROR


def test_wav_round_trip():
    x = np.sin(np.arange(8000) / 9) * 0.5
    assert np.abs(chroma.decode_wav(chroma.encode_wav(x)) - x).max() < 1e-3
    assert len(chroma.decode_wav(chroma.encode_wav(x, 8000))) == 4000 and len(chroma.decode_wav(None)) == 0


def test_broken_and_other_recordings():
    x = np.sin(np.arange(4000) / 9) * 0.5
    good = chroma.encode_wav(x)
    assert all(len(chroma.decode_wav(d)) == 0 for d in (b"", b"RIFF", b"no wave at all", good[:30]))
    assert len(chroma.decode_wav(good[:-1001])) == 3499
    for width, pack in ((1, lambda v: np.uint8(v * 127 + 128).tobytes()), (3, lambda v: b"".join(int(k * 8388607).to_bytes(3, "little", signed=True) for k in v)), (4, lambda v: np.int32(v * 2147483647).tobytes())):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(2)
            w.setsampwidth(width)
            w.setframerate(chroma.RATE)
            w.writeframes(pack(np.repeat(x, 2)))
        assert np.abs(chroma.decode_wav(out.getvalue()) - x).max() < 0.02


def test_recall_on_noisy_and_changed_clips():
    """Clips that start elsewhere, with noise and three or eight of 64 notes changed, are found again; strangers are not."""
    rng = np.random.default_rng(8)
    melodies = [rng.uniform(-0.4, 0.4, 64) for _ in range(80)]
    prints = [chroma.items(chroma.chroma(chroma.render(list(v)))) for v in melodies]
    match = lambda g: bool(g and g[1] >= chroma.MIN_VOTES and g[3] / (32 * g[2]) <= chroma.MAX_BIT_ERROR)
    for noise, changed, least in ((0.03, 0, 1.0), (0.01, 3, 0.98), (0.01, 8, 0.9)):
        found = 0
        for v, a in zip(melodies, prints):
            w = v.copy()
            w[rng.integers(0, 64, changed)] = rng.uniform(-0.4, 0.4, changed)
            clip = chroma.render(list(w))[rng.integers(0, 16) * chroma.HOP :]
            found += match(chroma.align(a, chroma.items(chroma.chroma(clip + rng.normal(0, noise, len(clip))))))
        assert found >= least * len(melodies)
    assert not any(match(chroma.align(a, b)) for i, a in enumerate(prints) for b in prints[:i])


def test_search_by_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [rng.normal(0, 0.2, 64) for _ in range(30)]
    rows = []
    for i in range(110):
        v = base[i % 30].copy()
        if i >= 60:
            v = np.roll(v, 5 if i % 2 else 0)
            v[rng.integers(0, 64, 3)] = rng.normal(0, 0.2, 3)
        rows.append((i, [float(x) for x in v], "x"))
    rows += [(500, rows[0][1], "x"), (501, None, "x"), (502, [], "x"), (503, [0.1], "x"), (None, rows[1][1], "x"), (504, [0.0] * 64, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query string")
    got = chroma.search(chroma.fingerprints(df, chroma.render, "vec_id", "embedding"))
    prints = {i: tuple(chroma.items(chroma.chroma(chroma.render(v)))) for i, v, _ in rows if i is not None}
    classes = {}
    for i in sorted(prints):
        classes.setdefault(prints[i], i)
    member = got.where("query_class is null").collect()
    assert len(member) == len(rows) and all(r["class_id"] == classes[prints[r["id"]]] for r in member if r["id"] is not None)
    asked = {classes[prints[i]] for i in prints if i % 50 == 0}
    want = {}
    for c in classes.values():
        for q in asked - {c}:
            a = chroma.align(np.array(prints[q], np.uint32), np.array(prints[c], np.uint32)) if prints[q] and prints[c] else None
            if a and a[1] >= chroma.MIN_VOTES and a[3] / (32 * a[2]) <= chroma.MAX_BIT_ERROR:
                want[c, q] = a[:3]
    assert {(r["id"], r["query_class"]): (r["offset"], r["votes"], r["overlap"]) for r in got.where("query_class is not null").collect()} == want and want


# -- all of them on odd tables ------------------------------------------------------


ODD = [(1, None, "x"), (2, "", "x"), (None, "a b c", "x"), (3, "w " * 60_000, "x"), (4, "same text here", "x"), (4, "same text here", "x"), (5, "\u0000\ud7ff ▁ \n\n", "x")]


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, id string").withColumn("h", F.lit(1)).withColumn("score", F.lit("c"))
    n = len(rows)
    v = viterbi.Pieces.load()
    assert viterbi.encode_table(df, v).count() == n
    assert viterbi.encode_table(df.where("doc_id < 5 or doc_id is null"), v).where("not round_trip").count() == 0
    assert tokencount.count(df, tokencount.load()).count() == n
    assert simhash.near_duplicates(df).count() == n
    assert bidilm.score(df, bidilm.fit(df)).count() == n
    model = toxicity.fit(df, spark.createDataFrame([(1, 1, 0), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    assert toxicity.score(df, model).count() == n and toxicity.reject(df, model).columns == df.columns
    assert licences.scan(df).count() == 0
    items = spark.createDataFrame([(1, "same text here"), (None, "x"), (2, None)], "item_id long, text string")
    assert {r["id"] for r in decontam.matches(df, items).collect()} == ({4} if rows else set())
    assert urlfilter.judge(df.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "url"), *urlfilter.train([])).count() == n


# -- the pipeline ------------------------------------------------------------------


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        at = shared.cut(stage(spark, at, sf), name)
        seen.append(at)
        if name != "sentencepiece":
            assert at.columns == docs.columns
    assert docs.count() > seen[0].count() > seen[1].count() > seen[2].count() == seen[3].count()
    assert seen[3].where("not round_trip").count() == 0
    leaked = slow_matches([(r["doc_id"], r["text"]) for r in seen[1].collect()], [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    assert {r["doc_id"] for r in seen[1].collect()} - {r["doc_id"] for r in seen[2].collect()} == {d for d, _ in leaked}


def test_queries_are_all_there(spark, sf):
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]
    pages = queries.op4_url_filter(spark, sf)
    assert {"page_id", "host", "path", "rule", "verdict"} <= set(pages.columns) and pages.count() == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert {"doc_id", "held_out", "score", "predicted"} == set(queries.op9_toxicity(spark, sf).columns)
