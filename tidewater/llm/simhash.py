"""SimHash near-duplicate groups by tiled exact comparison.

Fingerprints are built in numpy (whole texts, shingles with repeats). Equal
fingerprints collapse to one node before anything is compared. Nodes meet in
*tables*: in each table those with equal key bits lie together, sorted by
population count, and tiles of them are compared by exclusive-or and bit
counts; tile pairs whose population counts differ beyond the radius are
skipped. Only edges that connect something new in a tile run leave it, so a
group of k near copies yields k - 1 links and not k squared, while every
connection is kept.

* one word of 64 bits, radius r: the bits are cut into r + 2 blocks and there
  is a table for each two blocks; r differing bits leave two blocks untouched,
  so no pair within the radius is missed.
* wide fingerprints (several words): tables of ``key_bits`` disjoint bits, for
  radii at which no exact index exists; the recall is that of bit sampling.

A table group over ``SLICE`` nodes is cut into slices and each two slices meet
in a task of their own, so no task grows with the largest group.

``keep_one``, the pipeline's stage, asks for a similarity of shingle sets. Bit
sampling would lose links there, so nodes meet under shingles of their own: two
sets at 4/5 or more share one of the first fifth of each, in any order that all
sets have in common. Under such a shingle the tiles compare wide fingerprints
within a generous radius, and what they connect is checked on the sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import components, cut, fields, forget, salted_join, small_batches, with_ids

SLICE = 1000
TILE = 128
#: Pairs of a tile whose sets are looked at one by one; more are counted together, so many shingles at a time (8 MB a side).
FEW_PAIRS, COLUMNS = 32, 1 << 14
#: Words of 64 bits of the fingerprints of shingle sets, and the distance beyond which two are no candidates: sets at 0.8
#: differ in 38.8 bits on average (standard deviation 5.7; 48 and 6.2 for sets of four or five).
WIDE, WIDE_RADIUS = 4, 72
#: Nodes that meet under one shingle in one task; shingles that the sets in one such task hold, 16 MB.
KEY_SLICE = 20_000
SET_SLICE = 2_000_000
#: Prefix shingles of more nodes than ``COMMON`` come last in the order; no more than ``HOT_KEYS`` of them (8 MB) do.
COMMON = 1000
HOT_KEYS = 1 << 20


def shingle_hashes(text: bytes | None, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every k-word shingle, in order, repeats included; a shorter text is one shingle; without words: none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)))) if len(words) >= k else [b" ".join(words)]
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), np.uint64)


def fingerprint(hashes: np.ndarray, width: int = 1) -> np.ndarray:
    """Majority bits of the hashes, ``width`` words of 64; words after the first take the hashes mixed anew. No hashes: zeros."""
    out = np.zeros(width, np.uint64)
    for i in range(width if len(hashes) else 0):
        h = hashes
        if i:
            h = h + np.uint64(0x9E3779B97F4A7C15 * i & (1 << 64) - 1)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
        ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, width: int = 1) -> DataFrame:
    """``(id, f0, f1, ...)``: one row a row of ``docs``; fingerprint words as signed longs."""
    small_batches(docs.sparkSession)
    names = [f"f{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [fingerprint(shingle_hashes(t, k), width) for t in b.column(1).cast(pa.binary()).to_pylist()]
            got = np.array(rows, np.uint64).reshape(-1, width).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[:, i]) for i in range(width))], ["id", *names])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"{fields(src, 'id')}, {', '.join(f'{n} long' for n in names)}")


def tables(width: int, radius: int, key_bits: int) -> list[list[int]]:
    """Bit masks (one per word) of each table's key."""
    if width == 1:
        n = radius + 2
        edges = [64 * i // n for i in range(n + 1)]
        block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n)]
        return [[block[i] | block[j]] for i, j in combinations(range(n), 2)]
    keys = [((1 << key_bits) - 1) << at for at in range(0, 64 * width - key_bits + 1, key_bits)]
    return [[k >> 64 * i & (1 << 64) - 1 for i in range(width)] for k in keys]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fits(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Can sets of these sizes have a similarity of 4/5?"""
    return 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)


def incidence(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    """A row a set: which of the sorted ``columns`` it holds."""
    out = np.zeros((len(sets), len(columns)), np.float32)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    at = np.minimum(np.searchsorted(columns, flat), len(columns) - 1)
    held = columns[at] == flat
    out[row[held], at[held]] = 1
    return out


def alike(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """``similar`` for all pairs of two lists of sets at once, from counts of what they share."""
    shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    both = np.zeros((len(left), len(right)), np.int64)
    for i in range(0, len(shared), COLUMNS):  # whole numbers below 2^24 are exact
        columns = shared[i : i + COLUMNS]
        both += (incidence(left, columns) @ incidence(right, columns).T).astype(np.int64)
    n, m = (np.array([len(x) for x in sets]) for sets in (left, right))
    return 5 * both >= 4 * (n[:, None] + m[None, :] - both)


def links_in(keys: np.ndarray, fps: np.ndarray, radius: int, tile: int = TILE, sizes: np.ndarray | None = None, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Index pairs of rows within the radius that together connect all such pairs of tiles that share a key.

    ``keys`` must be grouped and, within a key, ``fps`` sorted by population
    count. With ``sizes`` only rows of fitting sizes pair; with ``sets`` only
    rows whose sets are similar.
    """
    n = len(keys)
    pop = np.bitwise_count(fps).sum(1, dtype=np.int32)
    label = np.arange(n)
    out: list[tuple[int, int]] = []
    for a in range(0, n, tile):
        a1 = min(a + tile, n)
        for b in range(a, n, tile):
            if b > a and keys[b] != keys[a1 - 1]:
                break
            b1 = min(b + tile, n)
            if b > a and keys[a] == keys[b1 - 1] and pop[b] - pop[a1 - 1] > radius:
                break  # one key, sorted: all later tiles are further off
            if (label[a:a1] == label[a]).all() and (label[b:b1] == label[a]).all():
                continue  # all connected already
            near = np.zeros((a1 - a, b1 - b), np.int16)
            for w in range(fps.shape[1]):
                near += np.bitwise_count(fps[a:a1, w][:, None] ^ fps[b:b1, w][None, :])
            new = (near <= radius) & (label[a:a1][:, None] != label[b:b1][None, :])
            if sizes is not None:
                new &= fits(sizes[a:a1][:, None], sizes[b:b1][None, :])
            if a == b:
                new = np.triu(new, 1)
            if sets is not None and new.sum() > FEW_PAIRS:
                i, j = (np.flatnonzero(new.any(axis)) for axis in (1, 0))
                new[np.ix_(i, j)] &= alike([sets[a + x] for x in i], [sets[b + x] for x in j])
                known = True
            else:
                known = sets is None
            while len(at := np.flatnonzero(new.any(1))):
                i = int(at[0])
                j = int(np.argmax(new[i]))
                new[i, j] = False
                if not known and not similar(sets[a + i], sets[b + j]):
                    continue
                out.append((a + i, b + j))
                old, to = label[a + i], label[b + j]
                label[label == old] = to
                new &= label[a:a1][:, None] != label[b:b1][None, :]
    return out


def whole_groups(key: str, work: Callable[[pa.Table], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function for rows sorted by ``key``: ``work`` gets tables that hold every row of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(key).to_numpy()
            if held and keys[0] != last:
                yield work(pa.Table.from_batches(held))
                held = []
            whole = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            if whole:
                yield work(pa.Table.from_batches([*held, b.slice(0, whole)]))
                held = []
            held.append(b.slice(whole))
            last = keys[-1]
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def sliced(keyed: DataFrame, *columns: str) -> DataFrame:
    """``(key, pop, *columns)`` of ``keyed(key, slices, node, f0, ...)``, dealt and sorted by a key that each two slices of a large key have for themselves."""
    spark = keyed.sparkSession
    names = [c for c in keyed.columns if c[0] == "f" and c[1:].isdigit()]
    mine = F.pmod(F.xxhash64("node", F.lit("slice")), F.col("slices")).cast("int")
    rows = keyed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    pop = sum((F.bit_count(n) for n in names), F.lit(0))
    key = F.when(F.col("slices") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))
    dealt = rows.select(key.alias("key"), pop.alias("pop"), *columns)
    return dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key", "pop", "node")


def compared(keyed: DataFrame, names: list[str], radius: int, with_sets: bool = False) -> DataFrame:
    """Links ``(a, b)`` by tiles of the rows of ``keyed(key, slices, node, f0, ...[, n][, shingles])`` that share a key."""
    more = [c for c in ("n", "shingles") if c in keyed.columns]

    def work(t: pa.Table) -> pa.RecordBatch:
        fps = np.stack([t.column(x).to_numpy() for x in names], 1).view(np.uint64)
        sizes = t.column("n").to_numpy().astype(np.int64) if "n" in more else None
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()] if with_sets else None
        found = np.array(links_in(t.column("key").to_numpy(), fps, radius, sizes=sizes, sets=sets), np.int64).reshape(-1, 2)
        node = t.column("node").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(node[found[:, 0]]), pa.array(node[found[:, 1]])], ["a", "b"])

    return sliced(keyed, "node", *names, *more).mapInArrow(whole_groups("key", work), "a long, b long").distinct()


def links(nodes: DataFrame, radius: int, width: int = 1, key_bits: int = 12) -> DataFrame:
    """Links ``(a, b)`` between rows of ``nodes(node, f0, ...)`` that connect all pairs within the radius found in some table."""
    names = [f"f{i}" for i in range(width)]
    masked = [F.xxhash64(F.lit(t), *[F.col(n).bitwiseAND(F.lit(signed(m))) for n, m in zip(names, mask)]) for t, mask in enumerate(tables(width, radius, key_bits))]
    keyed = nodes.withColumn("key", F.explode(F.array(*masked)))
    hot = keyed.groupBy("key").count().where(F.col("count") > SLICE).select("key", F.ceil(F.col("count") / SLICE).cast("int").alias("slices"))
    keyed = keyed.join(hot, "key", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    return compared(keyed, names, radius)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 3, width: int = 1, key_bits: int = 12) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row of ``docs``.

    Rows link if their fingerprints differ in ``radius`` bits or fewer;
    ``component_id`` is the smallest id that links reach, the row's own included.
    Null and empty texts, and texts of white space, have fingerprint zero and
    link like any other. Equal texts, repeated rows and ties share a
    fingerprint and so a component. A null id keeps its row; it never is a
    component id unless the whole component has none. Other columns of ``docs``
    are ignored, whatever their names. No rows: no rows.
    """
    names = [f"f{i}" for i in range(width)]
    fps = cut(fingerprints(docs, id_col, text_col, k, width), "simhash")
    # several words are told apart by a hash of them; one word is its own node
    node = F.col("f0") if width == 1 else F.xxhash64(*names)
    fps = fps.withColumn("node", node)
    nodes = cut(fps.groupBy("node", *names).agg(F.min("id").alias("low")), "simhash-nodes")
    roots = components(links(nodes.drop("low"), radius, width, key_bits))
    roots = cut(nodes.select("node", "low").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "simhash-roots")
    lowest = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    of_node = salted_join(roots.select("node", "root"), lowest, "root").select("node", "component_id")
    text = F.concat(*[F.lower(F.lpad(F.hex(n), 16, "0")) for n in names])
    return salted_join(fps, of_node, "node").select("id", text.alias("fingerprint"), "component_id")


# -- exact similarity of shingle sets ---------------------------------------------


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Is the Jaccard similarity of two sorted sets 4/5 or more? In whole numbers: no rounding."""
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def prefix(shingles: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The first fifth of a sorted set, and one more; those of ``hot`` (sorted) come last in the order.

    Sets at 4/5 share at least 4/5 of either. So what comes after the first fifth
    and one can't hold all that they share, whatever the order, if only all sets have the same.
    """
    if len(hot) and len(shingles):
        common = hot[np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)] == shingles
        shingles = np.concatenate([shingles[~common], shingles[common]])
    return shingles[: len(shingles) // 5 + 1]


def node_of(shingles: np.ndarray) -> int:
    return signed(xxhash.xxh64_intdigest(shingles.tobytes(), seed=7))


def shingle_sets(src: DataFrame, k: int, hot: np.ndarray | None = None, with_sets: bool = False) -> DataFrame:
    """``(id, node, n, f0, ..., keys)`` of ``src(id, text)``: a set's name, size, fingerprint and prefix; with ``with_sets``: ``(node, shingles)``."""
    small_batches(src.sparkSession)
    names = [f"f{i}" for i in range(WIDE)]
    hot = np.zeros(0, np.uint64) if hot is None else hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t, k)) for t in b.column(1).cast(pa.binary()).to_pylist()]
            nodes = pa.array([node_of(x) for x in sets], pa.int64())
            if with_sets:
                yield pa.RecordBatch.from_arrays([nodes, pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "shingles"])
                continue
            fps = np.array([fingerprint(x, WIDE) for x in sets], np.uint64).reshape(-1, WIDE).view(np.int64)
            keys = pa.array([prefix(x, hot).view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), nodes, pa.array([len(x) for x in sets], pa.int32()), *(pa.array(fps[:, i]) for i in range(WIDE)), keys], ["id", "node", "n", *names, "keys"])

    schema = "node long, shingles binary" if with_sets else f"{fields(src, 'id')}, node long, n int, {', '.join(f'{x} long' for x in names)}, keys array<long>"
    return src.select("id", "text").mapInArrow(run, schema)


def common_keys(src: DataFrame, k: int) -> np.ndarray:
    """Prefix shingles of more than ``COMMON`` sets, as far as they occur twice in a task: an order for speed, on which no result depends."""
    small_batches(src.sparkSession)
    none = np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [none], 0, set()

        def out() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key[n > 1].view(np.int64)), pa.array(n[n > 1])], ["key", "n"])

        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                if (digest := xxhash.xxh64_intdigest(t or b"")) not in seen:
                    seen.add(digest)
                    held.append(prefix(np.unique(shingle_hashes(t, k)), none))
                    size += len(held[-1])
            if size > 4_000_000:
                yield out()
                held, size, seen = [none], 0, set()
        yield out()

    counts = src.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > COMMON)
    got = counts.orderBy(F.desc("n"), "key").limit(HOT_KEYS).toArrow()
    return np.sort(got.column("key").to_numpy().view(np.uint64))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """``(id, component_id)`` for every row of ``docs``: texts link if the Jaccard similarity of their ``k``-word shingles is 0.8 or more.

    1. A first pass tells which shingles many texts have, such as those of a
       passage that a third of all documents hold; they come last in the order.
    2. Equal sets are one node, which keeps a fingerprint, its prefix and the smallest id.
    3. Nodes meet under the shingles of their prefixes (``prefix``: no similar
       pair is missed), where tiles compare fingerprints and sizes.
    4. Within what the tiles connect, tiles again, and each pair that they let
       through is checked on the sets themselves, unless checked pairs connect it
       already. Sets travel once for each slice of their group.

    Wordless texts are equal to each other. Links are those of checked pairs only.
    """
    names = [f"f{i}" for i in range(WIDE)]
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = cut(shingle_sets(src, k, common_keys(src, k)), "shingle-rows")
    nodes = cut(rows.groupBy("node").agg(F.min("id").alias("low"), *[F.first(c).alias(c) for c in ("n", *names, "keys")]), "shingle-nodes")
    ids = cut(rows.select("id", "node"), "shingle-ids")
    forget(rows)

    keyed = nodes.select(F.explode("keys").alias("key"), "node")
    several = keyed.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / KEY_SLICE).cast("int").alias("slices"))
    shared = cut(keyed.join(several, "key"), "shingle-shared")
    meeting = nodes.select("node", "n", *names).join(shared.select("node").distinct(), "node", "left_semi")
    near = components(compared(salted_join(shared, meeting, "node", "inner", 1), names, WIDE_RADIUS)).withColumnRenamed("root", "key")

    members = cut(near.join(nodes.select("node", "low", "n", *names), "node"), "shingle-members")
    forget(shared)
    load = members.groupBy("key").agg(F.ceil(F.sum("n") / SET_SLICE).cast("int").alias("slices"))
    lows = cut(members.select(F.col("low").alias("id")).distinct(), "shingle-lows")
    sets = shingle_sets(with_ids(src, lows, "id", "left_semi"), k, with_sets=True).groupBy("node").agg(F.first("shingles").alias("shingles"))
    checked = compared(salted_join(members, load, "key", "inner").drop("low").join(sets, "node"), names, WIDE_RADIUS, with_sets=True)
    of_node = nodes.select("node", "low").join(components(checked), "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_node = cut(of_node, "shingle-roots")
    forget(nodes, members, lows)

    lowest = of_node.groupBy("root").agg(F.min("low").alias("component_id"))
    of_node = salted_join(of_node.select("node", "root"), lowest, "root").select("node", "component_id")
    return salted_join(ids, of_node, "node").select("id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest id; of rows with an equal id the one whose columns hash lowest.

    Groups are those of ``similar_groups``: fingerprints alone decide nothing here.
    Rows with a null id are kept: nothing tells them apart.
    """
    groups = cut(similar_groups(docs.where(F.col(id_col).isNotNull()), id_col, text_col, k), "groups")
    by_id = groups.groupBy("id").agg(F.count("*").alias("times"), F.max(F.col("id") == F.col("component_id")).alias("stays"))
    by_id = cut(by_id.where("times > 1 or not stays"), "groups-of-ids")
    kept = with_ids(docs, by_id.where("not stays").select("id"), id_col, "left_anti")
    again = by_id.where("stays").select("id")
    if again.isEmpty():
        return kept.select(*docs.columns)
    once = with_ids(kept, again, id_col, "left_anti").select(*docs.columns)
    twice = with_ids(kept, again, id_col, "left_semi").groupBy(F.col(id_col).alias("_id"))
    return once.unionByName(twice.agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")).select("row.*"))
