"""Secret scans by the novelty of strings under zstandard.

Three patterns find assignments, access keys and long hexadecimal strings. The
method adds what no pattern names: a candidate is a run of 16 or more letters,
digits and ``+ / _ = - .`` that mixes letters with digits and stands shortly after a
sensitive word on its line. Its novelty is the compressed bytes that it adds,
the compressor being primed with a dictionary of identifiers and with the text
around it (without the candidate itself, so that a repeated secret stays new).
Names, paths and placeholders are built of known pieces and cost little; random
strings cost about a byte a character. Candidates at ``NOVEL`` bytes a
character or more are reported as ``novel``.

Defined results: null texts count as empty; every row gives a row, with an empty
list where nothing is found; repeated rows give equal rows; whole texts are
searched, in code points; candidates that touch a pattern's span are dropped.
Other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import fields, small_batches

KINDS = ("assign", "access", "hex", "novel")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
ASSIGN = re.compile(r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# runs are maximal, so shorter ones need not be looked at
HEX = re.compile(rf"[0-9a-f]{{{LEAST_HEX},}}")
#: What any assignment holds; tested on the lower-cased text before the pattern is tried.
NAMES = ("passw", "secret", "token", "api_key", "apikey")

#: Words after which a value is sensitive. Prose has some of them too; novelty decides.
SENSITIVE = ("passphrase", "password", "passwd", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "private", "signature", "session", "cookie", "login")
SENSITIVE_RE = re.compile(f"(?ia:{'|'.join(SENSITIVE)})")
#: Characters before a candidate in which the word must end; text on either side that primes the compressor.
REACH, AROUND = 40, 700
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
NOVEL = 0.8
#: Pieces of names that code and prose are full of; random strings share next to none of them.
IDENTIFIERS = """
access account action active address admin agent amount analytics android api app application archive array asset async attribute auth authorization
backend backup balance base base64 batch billing binary block body boolean branch browser bucket buffer build button byte cache callback cancel canvas
card category certificate channel char check class client cloud cluster code collection color column command comment commit common component config
configuration connection console const container content context control controller cookie copy core count create credential current customer dashboard data
database date debug default define delete deploy description detail dev device dict digest directory disable display document domain download driver
element email empty enable encode encoding endpoint engine entity entry enum environment error event example.com example.net example.org exception
execute expire export extension external factory false feature fetch field file filter final first float folder font format frame framework from function
gateway generate getenv github.com github global google graph group handler hash header health height hidden history host html http https icon identifier
image import include index info init input insert instance integer interface internal invalid item iterator java javascript job json kernel key keyboard
label language last layer layout length level library license limit line link list listener load local localhost location lock log login loop main manager
map master match max memory menu message metadata method metric middleware min mobile mode model module monitor mount name namespace network next node
notification null number object offset online open operation option order organization origin output owner package page param parameter parent parse
partition password path pattern payload payment performance permission phone pipeline plugin point policy pool port position post prefix preview primary
private process product production profile program project prompt property protocol provider proxy public publish query queue random range read receive
record redirect reference refresh region register release remote remove render replace report repository request require reset resource response rest
result retry return role root route router runtime sample schedule schema scope script search secret section secure security select send sequence server
service session setting setup shared signature size slot snapshot socket sort source spark sql stack staging standard start state static status step
storage store stream string style submit subscription success suffix summary sync system tab table tag target task team template temp tenant test
text thread threshold time timeout timestamp title token tool topic total trace track transaction transform transport true type undefined unique unit
update upload uri url user username utf-8 util uuid valid validate value variable vector vendor version video view virtual visible volume warning web
website webhook widget width window worker workflow workspace write www. yaml your- your_ zone
0123456789 123456789 1234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ xxxxxxxxxxxxxxxx 0000000000000000 ---------------- ================
changeme placeholder foobar EXAMPLEKEY sha256 sha512 md5 rsa ecdsa aes-256-cbc x86_64 linux windows darwin amd64 arm64 us-east-1 eu-west-1 v1.0 v2.0
"""
#: Code before every text, so that the compressor codes single characters by frequency even where little surrounds a candidate.
PREAMBLE = "import os\n\n\ndef load(path, fallback=None):\n    with open(path) as lines:\n        return [x.strip() for x in lines if x] or fallback\n\n\nclass Store(dict):\n    by_name = {}\n"


@functools.cache
def compressor() -> zstandard.ZstdCompressor:
    """Primed with the identifiers, small and with capitals; one a process."""
    primer = zstandard.ZstdCompressionDict((IDENTIFIERS.title() + IDENTIFIERS).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(19, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=primer, compression_params=params)


def novelty(value: str, before: str, after: str) -> int:
    """Compressed bytes that ``value`` adds to identifiers and surroundings; its other occurrences around it don't count."""
    before, after = PREAMBLE + before.replace(value, " "), after.replace(value, " ")
    size = lambda text: len(compressor().compress(text.encode("utf-8", "replace")))
    return size(before + value + after) - size(before + " " + after)


def patterns(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, value)`` of the three patterns: leftmost matches that don't overlap within a kind, too short ones then dropped."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(*m.span(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(*m.span(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    return out + [(*m.span(), "hex", m[0]) for m in HEX.finditer(text)]


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Mixed runs after a sensitive word on the same line; each run once."""
    seen = -1
    for word in SENSITIVE_RE.finditer(text):
        begin = word.end()
        line = text.find("\n", begin, begin + REACH + 1)
        # the run may begin at REACH at the latest, and end anywhere
        last = begin + REACH if line < 0 else line
        at = begin
        while at <= last:
            m = CANDIDATE.search(text, at)
            if m is None or m.start() > last:
                break
            start, end = m.span()
            at = end
            if start < begin or start <= seen:
                continue
            if start == begin and begin and re.match(r"\w", text[begin - 1]):
                # the run goes on from the word itself: `keyboard_layout_2`, `token=...` are looked at as a whole
                while start and CANDIDATE.match(text[start - 1] * 16):
                    start -= 1
            value = text[start:end]
            if any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
                seen = end
                yield start, end


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """All spans of a text by start, then kind."""
    text = text or ""
    out = patterns(text)
    low = text.lower()
    if any(w in low for w in SENSITIVE):
        taken = sorted((s, e) for s, e, *_ in out)
        for start, end in candidates(text):
            if any(s < end and start < e for s, e in taken):
                continue
            value = text[start:end]
            if novelty(value, text[max(0, start - AROUND) : start], text[end : end + AROUND]) >= NOVEL * len(value):
                out.append((start, end, "novel", value))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SPAN = "struct<kind: string, start: int, end: int, value: string>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, found)`` for every row, ``found`` the spans with their values in order."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e, "value": v} for s, e, k, v in find(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["id", "found"])

    return src.mapInArrow(run, f"{fields(src, 'id')}, found array<{SPAN}>")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """The counts of the patterns, the digest of their spans, and all spans."""
    number = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"] != "novel")
    return found.select("id", *map(number, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
