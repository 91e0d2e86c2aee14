"""URL filters: host and path rules, else a logistic regression on hashed character n-grams.

The regression learns from a small labelled table of URLs, in numpy, on the
driver. Rules are looked up by every suffix of the host, so their number costs
nothing a row; of those that fit the longest (host and path together) decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import small_batches

# The rules of the contract.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

# Words of the labelled URL table: general ones of unwanted sites, and of any other. None was taken from the tables that the filter is tried on.
BAD = """viagra cialis levitra pharmacy tramadol steroids painkiller poker roulette blackjack slots jackpot betting wager gambling lottery bingo sweepstakes prize giveaway
    loans payday credit-repair refinance debt cash money quick-cash mortgage discount bargain coupon clearance outlet replica knockoff luxury-watches handbags
    xxx porn sex cams nude erotic milf fetish escort dating hookup singles webcam banner popup popunder clicks clickbait traffic retarget pixel affiliate referral
    seo backlinks doorway linkwheel crack warez keygen torrent serial nulled hack exploit phish verify-account account-alert login-secure update-billing
    bitcoin forex binary-options miracle diet weightloss slimming keto hair-loss anti-aging testosterone enlargement supplements detox unlimited
    instant guaranteed limited-offer best-price lowest buy-now order-now deals promo bonus vip-club work-from-home get-rich secret-trick""".split()
GOOD = """news library weather garden museum science recipes school sports travel station nation house music history health kitchen university research journal review
    weekly daily times tribune gazette city council county river mountain forest ocean island harbour market bakery coffee books reader writer letters theatre cinema
    gallery studio design paper print photo camera bicycle railway airport transport energy solar water earth planet nature animals birds flowers leather
    cotton wood stone metal garage motor engine tools builder plumber dentist clinic doctor hospital teacher student college academy language grammar english
    bank insurance lawyer notary tax software network server hosting data cloud mobile phone radio television video game chess football tennis swimming hiking
    climbing hotel restaurant tourism education foundation association institute society parliament ministry embassy court police fire rescue church temple
    cathedral choir orchestra opera dance painting sculpture pottery weaving knitting fishing sailing rowing cycling running athletics gymnastics
    mathematics physics chemistry biology geology astronomy philosophy psychology medicine nursing therapy nutrition cooking baking brewing dairy
    orchard vineyard horse cattle sheep honey mill bridge tunnel canal castle village town street square park playground nursery kindergarten""".split()
PREFIXES = ["", "www.", "blog.", "m."]
TLDS = ["com", "net", "org", "info", "example.com", "example.net", "example.org", "co.uk", "de", "es"]
PATHS = ["/en/1", "/fr/22", "/de/333.html", "/es/44/", "/", "/index.html", "/a/b?c", "/2024/05/title"]

BUCKETS = 1 << 16
#: Lengths of n-grams, chosen by the loss on quarters of the table that were held out by word.
GRAMS = (2, 3, 4)


def labelled(every: int = 1, left: int = 0) -> list[tuple[str, str, int]]:
    """The labelled table, (host, path, 1 for block), or its rows whose pair of words leaves ``left`` modulo ``every``; no host is harmless.

    A host is one word or two neighbours of a fixed stride through its list,
    joined with and without a hyphen; an unwanted word makes a host unwanted
    beside a harmless one too. Prefixes, domains and paths go round alike for
    both labels, so that they tell nothing.
    """

    def hosts(one: list[str], two: list[str], stride: int) -> list[list[str]]:
        return [[a + glue + two[(i * stride + 5) % len(two)] for glue in ("-", "")] for i, a in enumerate(one)]

    bad = [[w] for w in BAD] + hosts(BAD, BAD, 7) + hosts(BAD, BAD, 11) + hosts(BAD, GOOD, 13) + hosts(GOOD[::2], BAD, 3)
    good = [[w] for w in GOOD] + hosts(GOOD, GOOD, 7) + hosts(GOOD, GOOD, 31)
    out = []
    for y, groups in ((1, bad), (0, good)):
        for i, group in enumerate(groups):
            for j, name in enumerate(group):
                at = 3 * i + j
                if i % every == left:
                    out.append((f"{PREFIXES[at % len(PREFIXES)]}{name}.{TLDS[at % len(TLDS)]}", PATHS[at % len(PATHS)], y))
    return out + [("", "", 0)] * 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL as the contract cuts them; null or without ``://``: both empty."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of all texts, by a rolling hash over their bytes."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    rows, buckets = [], []
    rolled = data
    for n in range(2, max(GRAMS) + 1):
        rolled = rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + data[n - 1 :] if len(rolled) > 1 else rolled[:0]
        if n in GRAMS:
            inside = np.arange(len(rolled)) + n <= ends[: len(rolled)]
            mixed = (rolled[inside] ^ (rolled[inside] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            buckets.append((mixed >> np.uint64(48)).astype(np.int64) % BUCKETS)
            rows.append(owner[: len(rolled)][inside])
    return np.concatenate(rows), np.concatenate(buckets)


def featured(hosts: list[str], paths: list[str]) -> list[str]:
    """Host and path with marks, so that n-grams know which they are of."""
    return [f"^{h}$ {p}~" for h, p in zip(hosts, paths)]


def margins(hosts: list[str], paths: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """Log-odds; features count by frequency among a URL's n-grams."""
    rows, buckets = grams(featured(hosts, paths))
    total = np.maximum(np.bincount(rows, minlength=len(hosts)), 1)
    return np.bincount(rows, weights[buckets], len(hosts)) / total + bias


def train(table: list[tuple[str, str, int]], epochs: int = 1000, rate: float = 2000.0, decay: float = 1e-5, prior: float | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent with decay; with ``prior`` the bias then moves from the table's share of unwanted URLs to that. No rows: zeros."""
    weights, bias = np.zeros(BUCKETS), 0.0
    if not table:
        return weights, bias
    hosts, paths, y = [t[0] for t in table], [t[1] for t in table], np.array([t[2] for t in table], float)
    rows, buckets = grams(featured(hosts, paths))
    share = 1 / np.bincount(rows, minlength=len(y))[rows]
    for _ in range(epochs):
        error = (1 / (1 + np.exp(-(np.bincount(rows, weights[buckets] * share, len(y)) + bias))) - y) / len(y)
        weights -= rate * (np.bincount(buckets, error[rows] * share, BUCKETS) + decay * weights / len(y))
        bias -= error.sum()
    if prior is not None and 0 < (share_bad := y.mean()) < 1:
        bias += np.log(prior / (1 - prior)) - np.log(share_bad / (1 - share_bad))
    return weights, float(bias)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct (length, rule, verdict) or null; ties go to the rule later in the alphabet."""
    by_host: dict[str, list[tuple[str, str]]] = {}
    for h, p, v in rules:
        by_host.setdefault(h, []).append((p, v))
    if not by_host:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    entry = lambda h, p, v: F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(p).alias("path"))
    known = F.create_map(*[x for h, ps in sorted(by_host.items()) for x in (F.lit(h), F.array(*[entry(h, p, v) for p, v in ps]))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(known, s), F.array().cast("array<struct<size:int,rule:string,verdict:string,path:string>>")))), lambda r: F.startswith(path, r["path"]))
    return F.array_max(fitting)


def judge(pages: DataFrame, weights: np.ndarray, bias: float, rules: list[tuple[str, str, str]] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id, host, path, rule, verdict, score)`` for every row: the rule's verdict, else block where the regression's score is 0.5 or more.

    Null urls and those without ``://`` have an empty host and path and are
    judged by the regression like any other; repeated rows and ties are judged
    alike. Other columns are ignored.
    """
    small_batches(pages.sparkSession)
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    src = src.select("id", host.alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for h, p in batches:
            m = margins(h.to_pylist(), p.to_pylist(), weights, bias) if len(h) else np.zeros(0)
            yield pa.array(1 / (1 + np.exp(-np.clip(m, -50, 50))))

    score = F.arrow_udf(run_typed(run), "double")
    scored = src.withColumn("score", score("host", "path")).withColumn("_rule", rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "score")


def run_typed(run):  # noqa: ANN001, ANN201
    """The iterator form that ``arrow_udf`` reads from type hints; future annotations would hide them."""

    def scores(batches):  # noqa: ANN001, ANN202
        return run(batches)

    scores.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return scores
