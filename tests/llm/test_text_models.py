"""Toxicity, pseudo-likelihood, Viterbi pieces, token counts, licences, URL filters: brute force, round trips, held-out accuracy."""

from __future__ import annotations

import random
import re
import time
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.llm import bidilm, licences, queries, tokencount, toxicity, urlfilter, viterbi

# -- pieces -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return viterbi.Pieces.load()


def full_viterbi(text, v):
    """The best score over the whole marked text, no window, no memo."""
    s = viterbi.MARK + text.replace(" ", viterbi.MARK)
    best = [0.0] + [-np.inf] * len(s)
    for end in range(1, len(s) + 1):
        for i in range(max(0, end - v.longest), end):
            p = v.score.get(s[i:end], v.unknown if i == end - 1 else None)
            if p is not None:
                best[end] = max(best[end], best[i] + p)
    return best[-1]


def score_of(ids, v):
    by_id = {i: v.score[p] for p, i in v.ids.items()}
    return sum(by_id.get(i, 0.0) for i in ids), sum(i not in by_id for i in ids)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abeth onéç \n漢😀.,'0"), max_size=60))
def test_pieces_are_the_best_and_come_back(pieces, text):
    ids = viterbi.encode(text, pieces)
    assert viterbi.decode(ids, pieces) == text
    if text and all(c in pieces.ids or c == " " for c in text):
        assert score_of(ids, pieces) == (pytest.approx(full_viterbi(text, pieces), abs=1e-6), 0)


@pytest.mark.parametrize("text", ["a" * 5000, "thetionandof" * 700, "漢字" * 300, "the  quick   brown ", " ", "\n\n", "x" * 47, "x" * 49])
def test_long_stretches_stream(pieces, text):
    ids = viterbi.encode(text, pieces)
    assert viterbi.decode(ids, pieces) == text
    marked = viterbi.MARK + text.replace(" ", viterbi.MARK)
    streamed = list(viterbi.stream(iter(marked), pieces))
    assert viterbi.decode(streamed, pieces) == text
    if all(c in pieces.ids for c in marked):
        assert score_of(streamed, pieces)[0] == pytest.approx(full_viterbi(text, pieces), abs=1e-6)


@pytest.mark.parametrize("unit", ["=", "-", "a", "ab", "漢", " ", "0", "thetion"])
def test_runs_take_linear_time_and_a_short_window(pieces, unit, monkeypatch):
    took, longest = {}, 0
    meeting = viterbi._meeting

    def watched(best, back, start, end):
        nonlocal longest
        longest = max(longest, len(best))
        return meeting(best, back, start, end)

    monkeypatch.setattr(viterbi, "_meeting", watched)
    for n in (10_000, 300_000):
        text = unit * (n // len(unit))
        began = time.perf_counter()
        ids = viterbi.encode(text, pieces)
        took[n] = time.perf_counter() - began
        assert viterbi.decode(ids, pieces) == text
    assert took[300_000] < 60 * max(took[10_000], 0.02)
    assert longest < 3 * viterbi.CHUNK or unit in "=-"  # their paths hang on the run's length


@pytest.mark.parametrize("text", ["▁", "a▁b", " ▁ ", "▁▁ x", "x y " * 40_000, "  a" * 60_000, "a" * 70_000 + " " + "b c" * 9])
def test_marks_and_blocks_come_back(pieces, text):
    assert viterbi.decode(viterbi.encode(text, pieces), pieces) == text


def test_window_commits_before_the_end(pieces):
    """Ids come out while the stream still runs."""
    read = 0

    def chars():
        nonlocal read
        for c in viterbi.MARK + "thetionand" * 200:
            read += 1
            yield c

    next(viterbi.stream(chars(), pieces))
    assert read < 100


def test_no_worse_than_the_library_lattice(pieces):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = pb.ModelProto()
    with open(viterbi.MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    sp = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    for text in ("the quick brown fox jumps", "onthanen thwhor ereation", "Licensed under the MIT License."):
        (ours, unknown), (theirs, _) = score_of(viterbi.encode(text, pieces), pieces), score_of(sp.encode(text), pieces)
        assert ours >= theirs and not unknown


# -- token counts -----------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "'re", "'", "r", " ", "  ", "\n", "12", "!", "é", "'ll", "x", "\t "]), max_size=90), st.lists(st.tuples(st.integers(0, 120), st.integers(0, 8), st.sampled_from(["", "z", " e", "'r", "\n\n", "  ", "9"])), max_size=6))
def test_edits_count_as_if_encoded_anew(parts, edits):
    c = tokencount.counter(tokencount.load())
    d = tokencount.Document("".join(parts), c)
    for start, size, new in edits:
        d.edit(start, start + size, new)
        assert d.tokens == len(c.encoding.encode_ordinary(d.text))
        assert (d.tree.all_chars if d.tree else 0) == len(d.text)


def test_edits_touch_little():
    c = tokencount.counter(tokencount.load())
    d = tokencount.Document("some words of a text " * 3000, c)
    assert d.edit(30_000, 30_003, "changed") < 12 and d.leaves > 14_000


# -- toxicity ---------------------------------------------------------------------


def test_crc_rule(spark):
    ids = [0, 1, 7, 123456789, -5]
    got = {r["i"]: r["h"] for r in spark.createDataFrame([(i,) for i in ids], "i long").select("i", toxicity.is_held_out(F.col("i")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in ids}


def test_unseen_spellings_and_held_out_accuracy():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["an", "er", "th", "on", "re", "in"]) for _ in range(rng.randint(1, 4)))
    texts, labels = [], []
    for i in range(900):
        words = [word() for _ in range(rng.randint(5, 300))]
        if i % 5 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["bloggle", "zarkish"]) + rng.choice(["", "s", "ed"]))
        texts.append(" ".join(words))
        labels.append(i % 5 == 0)
    model = toxicity.train(texts[:600], np.array(labels[:600], float))
    got = np.array(model.scorer().scores(texts[600:])) >= 0.3
    assert (got == np.array(labels[600:])).mean() > 0.97
    assert model.scorer().scores(["an er bloggl on", "an er bloggling th"]) > [0.5, 0.5]
    assert max(model.scorer().scores([None, "", "an er on " * 4000])) < 0.3


def test_labels_of_one_class():
    for y in (0.0, 1.0):
        s = toxicity.train(["a b", "c"], np.full(2, y)).scorer().scores(["x", ""])
        assert all((v > 0.5) == (y == 1.0) for v in s)
    assert toxicity.train([], np.zeros(0)).scorer().scores(["x"])[0] < 0.3


def test_toxicity_query(spark, sf):
    got = queries.op9_toxicity(spark, sf).toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.score.between(0, 1).all() and ((got.score >= 0.3).astype(int) == got.predicted).all()


# -- pseudo-likelihood ------------------------------------------------------------


def slow_class_score(model, c):
    """The sum over positions of the normalised product of what both networks say, by loops."""
    total = 0.0
    for i in range(2, len(c) - 2):
        x = [float(model.tables[0][c[i - 1], c[i + 1], k] + model.tables[1][c[i - 2], c[i + 2], k] - model.prior[k]) for k in range(1, bidilm.CLASSES)]
        total += x[c[i] - 1] - np.log(sum(map(np.exp, x)))
    return total


def test_scores_are_sums_of_conditionals(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat"), (2, ""), (3, None), (4, "the cat sat on the mat"), (5, "mat the")], "doc_id long, text string")
    model = bidilm.fit(docs)
    assert all(np.allclose(np.exp(t).sum(-1), 1, atol=1e-3) for t in model.tables)
    classes = bidilm.Classes(model.common)
    got = {r["id"]: r for r in bidilm.score(docs, model).collect()}
    for i, text in ((1, "the cat sat on the mat"), (5, "mat the")):
        assert got[i]["log_likelihood"] == pytest.approx(slow_class_score(model, [0, 0, *(classes[w] for w in text.split()), 0, 0]), abs=1e-3)
    assert got[1]["log_likelihood"] == got[4]["log_likelihood"]
    assert got[2]["n_words"] == got[3]["n_words"] == 0 and got[3]["per_word"] is None
    assert got[1]["per_word"] > np.log(1 / 20)  # it has learned what it was shown


def test_held_out_texts_score_by_their_order(spark):
    """Held-out texts of a small language are likelier than by word counts alone, and likelier than when shuffled."""
    rng = random.Random(4)
    things, acts, places = ([f"{k}{i}" for i in range(25)] for k in ("thing", "act", "place"))
    sentence = lambda: f"the {rng.choice(things)} will {rng.choice(acts)} in a {rng.choice(places)} ."
    text = lambda: " ".join(sentence() for _ in range(8))
    model = bidilm.fit(spark.createDataFrame([(i, text()) for i in range(300)], "doc_id long, text string"))
    held = [text() for _ in range(60)]
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in held]
    got = {r["id"]: r["per_word"] for r in bidilm.score(spark.createDataFrame(list(enumerate(held + mixed)), "doc_id long, text string"), model).collect()}
    assert all(got[i] > got[60 + i] + 1 for i in range(60))
    by_counts = -(6 * np.log(8) + 3 * np.log(8 * 25) - np.log(8)) / 8  # of eight words in a sentence, five are fixed
    assert np.mean([got[i] for i in range(60)]) > by_counts / 1.5


def test_counts_cover_the_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [r["text"] for r in docs.select("text").collect()]
    words = sum(len((t or "").lower().split()) for t in texts)
    assert bidilm.word_counts(docs).agg(F.sum("n")).first()[0] == words
    assert {r["distance"]: r["n"] for r in bidilm.triple_counts(docs, ["the", "of"]).groupBy("distance").agg(F.sum("n").alias("n")).collect()} == {1: words, 2: words}


@pytest.mark.parametrize("listed", [1 << 18, 1])
def test_words_of_one_class_score_by_their_own_counts(spark, monkeypatch, listed):
    monkeypatch.setattr(bidilm, "LISTED", listed)
    common = [f"c{i}" for i in range(bidilm.COMMON)]
    made = bidilm.Classes(common)
    same = [w for w in (f"r{i}" for i in range(2000)) if made[w] == made["r0"]][:3]
    texts = [" ".join(common)] * 9 + [f"c0 {same[0]} c1"] * 4 + [f"c0 {same[1]} c1"]
    asked = [f"c0 {w} c1" for w in same]  # the third doesn't occur
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = bidilm.fit(docs)
    got = {r["id"]: r["log_likelihood"] for r in bidilm.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    assert got[0] - got[1] == pytest.approx(np.log(4), abs=1e-5) and got[1] == pytest.approx(got[2], abs=1e-5)
    c = bidilm.Classes(model.common).of(asked[0])
    assert got[0] == pytest.approx(model.score(c) + np.log(4 / 5), abs=1e-5)


# -- licences ---------------------------------------------------------------------


def dice_rows(docs, templates, threshold):
    words = lambda t: [w for w in re.split(r"[^\w]+|_", t.lower()) if w]
    grams = lambda w: {(a, b) for a, b in zip(w, w[1:])}
    out = {}
    for i, text in docs:
        for p in {*(text or "").split("\n"), *re.split(r"\n\s*\n", text or ""), text or ""}:
            for name, body in templates:
                a, b = grams(words(p)), grams(words(body))
                d = 2 * len(a & b) / (len(a) + len(b)) if a and b else 0
                if d >= threshold:
                    out[i, name] = max(out.get((i, name), 0), round(d, 6))
    return out


def test_licences_by_brute_force(spark):
    mit = licences.MIT_GRANT
    docs = [(1, "x y\nReleased under the MIT License.\nend"), (2, mit.replace("publish", "print")), (3, mit.replace(", ", ",\n", 9)), (4, None), (5, ""), (6, "Licensed under the\nApache License, Version 2.0"), (7, "word " * 30000), (1, "Released under the MIT License."), (8, "a\n\nThis work is licensed under a Creative Commons\nAttribution 4.0 International License.\n\nb")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("licence", F.lit("clash"))
    got = {(r["id"], r["licence"]): r["dice"] for r in licences.scan(df).collect()}
    assert got == dice_rows(docs, licences.TEMPLATES, 0.8) and {k[0] for k in got} == {1, 2, 3, 6, 8}
    assert licences.scan(df.limit(0)).count() == 0


def test_licences_against_duckdb(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = sorted(con.execute(queries.oracle_sql()["op8_licences"]).fetchall())
    assert sorted(tuple(r) for r in queries.op8_licences(spark, sf).select("doc_id", "licence", "dice", "passages").collect()) == want


# -- URL filters ------------------------------------------------------------------

URLS = ["https://A.Example.COM/en/7/x?q", "http://b.com/en/1", "https://example.com", "ftp://x.net/de/9#a", "http://example.net/de/8", "notaurl", None, "", "http://sub.org/es/", "://", "http://poker-jackpot.example.net/fr/1", "http://xcom/en/", "a://b://c/d", "http://h?x/en/", "http://" + "a." * 3000 + "com/en/"]


def by_hand(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_url_rules_by_hand(spark):
    model = urlfilter.train(urlfilter.labelled())
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r["id"]: r for r in urlfilter.judge(df, *model).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = by_hand(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == (verdict or ("block" if got[i]["score"] >= 0.5 else "allow"))
    assert got[10]["verdict"] == "block" and got[5]["verdict"] == "allow"
    assert urlfilter.judge(df.limit(0), *model).count() == 0


def test_url_model_on_words_that_it_never_saw(spark):
    """Quarters of the table held out by word; then all pages, of whose unwanted hosts the table has no word."""
    tp = fp = fn = 0
    for left in range(4):
        model = urlfilter.train([row for other in range(4) if other != left for row in urlfilter.labelled(4, other)])
        held = [row for row in urlfilter.labelled(4, left) if row[0]]
        guess = urlfilter.margins([h for h, _, _ in held], [p for _, p, _ in held], *model) >= 0
        truth = np.array([y for *_, y in held]) == 1
        tp, fp, fn = tp + (guess & truth).sum(), fp + (guess & ~truth).sum(), fn + (~guess & truth).sum()
    print(f"held out: precision {tp / (tp + fp):.2f}, recall {tp / (tp + fn):.2f}")
    assert tp / (tp + fp) > 0.95 and tp / (tp + fn) > 0.8
    words = ["ads", "adult", "bets", "casino", "cheap", "farm", "free", "pills", "spam", "track", "win"]
    assert not any(w in bad for w in words for bad in urlfilter.BAD)
    rows = urlfilter.judge(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"), *urlfilter.train(urlfilter.labelled())).collect()
    bad = [any(re.search(rf"(^|[.-]){w}([.-]|$)", r["host"]) for w in words) for r in rows]
    hit = [r["score"] >= 0.5 for r in rows]
    both = sum(a and b for a, b in zip(bad, hit))
    print(f"pages: precision {both / sum(hit):.2f}, recall {both / sum(bad):.2f}")
    assert both >= 0.7 * sum(bad) and both >= 0.6 * sum(hit)


def test_url_model_against_brute_force():
    """Scores and one step of training, n-gram by n-gram."""
    table = urlfilter.labelled()[:60] + urlfilter.labelled()[-30:]
    weights, bias = urlfilter.train(table, epochs=1)
    buckets = []
    for h, p, _ in table:
        raw = urlfilter.featured([h], [p])[0].encode()
        mine = []
        for n in urlfilter.GRAMS:
            for i in range(len(raw) - n + 1):
                x = raw[i]
                for c in raw[i + 1 : i + n]:
                    x = (x * 0x9E3779B97F4A7C15 + c) % (1 << 64)
                x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) % (1 << 64)
                mine.append((x >> 48) % urlfilter.BUCKETS)
        buckets.append(mine)
    want, step = np.zeros(urlfilter.BUCKETS), 0.0
    for mine, (_, _, y) in zip(buckets, table):
        error = (0.5 - y) / len(table)
        step -= error
        for b in mine:
            want[b] -= 2000.0 * error / len(mine)
    assert np.allclose(weights, want) and bias == pytest.approx(step)
    got = urlfilter.margins([h for h, _, _ in table], [p for _, p, _ in table], weights, bias)
    assert np.allclose(got, [sum(want[b] for b in mine) / len(mine) + step for mine in buckets])
