"""Benchmark decontamination with SimHash windows, in DataFrame operations only.

1. Seeds. A window that holds no shingle of an item has similarity zero with it,
   so only documents that hold some are looked at, and only pairs of document and
   item whose seeds weigh enough for the threshold at all. Items of fewer words
   than ``K`` are one shingle of their own length, and documents are cut into
   shingles of those lengths as well, so that short items are found inside texts.
2. Windows as long as an item, in words, start at every seed after which enough
   others follow. Any other window does no better than the one at its first seed:
   moving it there drops what isn't shared and takes in more at its end.
3. Their SimHash (64 bits, each shingle as often as it occurs) meets those of the
   items whose seeds they start at by multi-index Hamming blocks: with ``RADIUS``
   + 1 blocks, two fingerprints within the radius agree in one at least. The
   blocks are joined within an item, so candidates are no more than the seeded
   starts; blocks of two and three bits alone would pair nearly all windows with
   nearly all items of their length.
4. Candidates are verified by exact weighted-shingle similarity, the weight of a
   shingle being its count: shared weight over the item's weight.

Fingerprinting every window of every item size would take some 40 sizes x all
words x 64 bits of interpreted work, hence the seeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import cut

K = 5
THRESHOLD = 0.8
#: 0.8 of weight shared leaves 11.8 of 64 bits differing on average (standard deviation 3.1): five deviations and more.
RADIUS = 28


def plain_words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(src: DataFrame, words: str, *keep: str, k: int = K) -> DataFrame:
    """A row ``(*keep, pos, h)`` for every ``k`` neighbouring words; fewer words: none."""
    n = F.greatest(F.size(words) - (k - 1), F.lit(0))
    ahead = [F.slice(words, i + 1, n).alias(f"w{i}") for i in range(k)]
    rows = src.where(F.size(words) >= k).select(*keep, F.posexplode(F.arrays_zip(*ahead)).alias("pos", "s"))
    return rows.select(*keep, "pos", F.xxhash64(*[F.col(f"s.w{i}") for i in range(k)]).alias("h"))


def shingles_of_lengths(src: DataFrame, words: str, lengths: list[int], *keep: str) -> DataFrame:
    """``shingles`` of every length of ``lengths``, with their ``k``."""
    out = None
    for k in lengths:
        rows = shingles(src, words, *keep, k=k).withColumn("k", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return out


def item_words(items: DataFrame, item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, uid, len, k, w)``: equal item ids with different texts are items of their own, told apart by ``uid``; ``k`` is the length of an item's shingles."""
    src = items.select(F.col(item_id).alias("item"), plain_words(F.col(text_col)).alias("w")).where(F.col("item").isNotNull() & (F.size("w") > 0)).distinct()
    return src.select("item", "w", F.size("w").alias("len"), F.least(F.size("w"), F.lit(K)).alias("k"), F.xxhash64("item", F.concat_ws(" ", "w")).alias("uid"))


def simhash(hashes: str = "h", times: str = "times") -> Column:
    """Aggregate: majority bits of the 64-bit hashes, each counted ``times``."""
    total = F.sum(times)
    bits = [F.when(2 * F.sum(F.when(F.getbit(hashes, F.lit(i)) == 1, F.col(times)).otherwise(0)) > total, F.lit((1 << i) if i < 63 else -(1 << 63))).otherwise(F.lit(0)) for i in range(64)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def blocks(fp: str) -> Column:
    """(block, bits) of each of RADIUS + 1 blocks."""
    n = RADIUS + 1
    edges = [64 * i // n for i in range(n + 1)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.col(fp), edges[i]).bitwiseAND(F.lit((1 << edges[i + 1] - edges[i]) - 1)).alias("bits")) for i in range(n)])


def candidates(starts: DataFrame, windows: DataFrame, items: DataFrame) -> DataFrame:
    """``(id, uid, len, start, distance)``: windows ``(id, len, start, fp)`` and items ``(uid, item_fp)`` that agree in a block, among the pairs of ``starts``."""
    left = starts.select("id", "uid", "len", "start").join(windows.select("id", "len", "start", "fp"), ["id", "len", "start"]).select("*", F.inline(blocks("fp")))
    right = items.select("uid", "item_fp", F.inline(blocks("item_fp")))
    near = left.join(right, ["uid", "block", "bits"]).withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))))
    return near.select("id", "uid", "len", "start", "distance")


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(id, item, similarity, distance)`` of every document and item with a window of the threshold or more; the best window counts.

    ``similarity`` is the window's shared shingle weight over the item's. Rows
    with a null id, null, empty or wordless texts and items match nothing; items
    of fewer than five words are one shingle, to be found anywhere; repeated rows
    are taken once, rows with one id and several texts count as one document.
    Ties between windows leave the same similarity and the least distance. Other
    columns are ignored. Items are a small table, but nothing here depends on it:
    the engine broadcasts them only if it finds them small.
    """
    known = cut(item_words(items), "items")
    lengths = sorted(r["k"] for r in known.select("k").distinct().collect()) or [K]  # K values at most
    grams = cut(shingles_of_lengths(known.withColumnRenamed("k", "own"), "w", lengths, "item", "uid", "len", "own").where("k = own").drop("own"), "item-shingles")
    grams = grams.withColumn("weight", F.col("len") - F.col("k") + 1)
    weights = grams.groupBy("uid", "k", "h").agg(F.count("*").alias("item_times"), F.first("len").alias("len"), F.first("weight").alias("weight"))
    src = docs.select(F.col(id_col).alias("id"), plain_words(F.col(text_col)).alias("w")).where(F.col("id").isNotNull())
    found = shingles_of_lengths(src, "w", lengths, "id").join(grams.select("k", "h").distinct(), ["k", "h"], "left_semi")
    # Seeds enough? Of each shingle no more than the item has can be shared.
    seeds = cut(found.groupBy("id", "k", "h").agg(F.count("*").alias("times"), F.collect_set("pos").alias("at")), "seeds")
    hits = seeds.join(weights, ["k", "h"])
    able = hits.groupBy("id", "uid").agg(F.sum(F.least("times", "item_times")).alias("w"), F.first("weight").alias("weight"), F.first("len").alias("len"), F.first("k").alias("k")).where(F.col("w") >= threshold * F.col("weight"))
    able = cut(able.select("id", "uid", "k", "len", "weight"), "able")
    # A window that starts at a seed reaches the threshold only if so many seeds more lie in it.
    more = F.ceil(threshold * F.col("weight") - 1e-9).cast("int") - 1
    run = hits.join(able.select("id", "uid"), ["id", "uid"]).groupBy("id", "uid", "k", "len", "weight").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"))
    enough = F.transform("at", lambda p, i: F.when(F.get("at", i + more) - p < F.col("weight"), p))
    starts = cut(run.select("id", "uid", "k", "len", F.explode(enough).alias("start")).where(F.col("start").isNotNull()), "starts")
    texts = src.join(able.select("id").distinct(), "id", "left_semi").distinct()
    window = starts.select("id", "k", "len", "start").distinct().join(texts, "id").select("id", "k", "len", "start", F.slice("w", F.col("start") + 1, F.col("len")).alias("part"))
    window = window.withColumnRenamed("k", "own")
    parts = shingles_of_lengths(window, "part", lengths, "id", "own", "len", "start").where("k = own").drop("own")
    parts = parts.groupBy("id", "k", "len", "start", "h").agg(F.count("*").alias("times"))
    of_window = parts.groupBy("id", "k", "len", "start").agg(simhash().alias("fp"))
    of_item = weights.withColumnRenamed("item_times", "times").groupBy("uid", "len").agg(simhash().alias("item_fp"))
    near = candidates(starts, of_window, of_item).where(F.col("distance") <= RADIUS)
    near = near.groupBy("id", "uid", "len", "start").agg(F.min("distance").alias("distance"))
    shared = parts.join(weights.select("uid", "k", "len", "h", "item_times", "weight"), ["k", "len", "h"]).join(near, ["id", "uid", "len", "start"])
    sims = shared.groupBy("id", "uid", "start", "weight", "distance").agg(F.sum(F.least("times", "item_times")).alias("both"))
    sims = sims.withColumn("similarity", F.col("both") / F.col("weight")).where(F.col("similarity") >= threshold).join(known.select("uid", "item"), "uid")
    best = F.max(F.struct("similarity", (-F.col("distance")).alias("d")))
    return sims.groupBy("id", "item").agg(best.alias("b")).select("id", "item", F.round("b.similarity", 6).alias("similarity"), (-F.col("b.d")).cast("int").alias("distance"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that hold a match; of rows with a null id each is judged by its own text."""
    key = F.when(F.col(id_col).isNull(), F.concat(F.lit("text:"), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))).otherwise(F.concat(F.lit("id:"), F.col(id_col).cast("string")))
    known = docs.select(key.alias("__leak_key"), F.col(text_col).alias("_text"))
    leaked = matches(known, items, "__leak_key", "_text").select(F.col("id").alias("__leak_key")).distinct()
    return docs.withColumn("__leak_key", key).join(leaked, "__leak_key", "left_anti").select(*docs.columns)
