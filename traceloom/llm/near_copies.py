"""Groups of rows whose texts share most of their word shingles.

Two texts are linked if the Jaccard similarity of their sets of five-word
shingles is at least SIMILARITY; linked texts form groups. The first candidates are
those that simhash_dedup groups by fingerprints of five-word shingles, each with
its group's smallest row; fingerprints at 0.8 differ in too many bits to be found
by parts (README), so the others meet under one of BANDS keys of DEPTH minimum hashes each (Broder, 1997): a pair of
similarity s shares none with probability (1 - s**DEPTH) ** BANDS, 5e-8 at 0.8.
Under a key of at most SMALL members each pair whose sketches, four bits of each of
512 minimum hashes, differ in at most APART places (Li and König, 2010; beyond that as
improbable at 0.8) is held against the exact similarity of its texts, under the first
key only that it shares.

The members of larger keys are compared with one of them, the hub: the one whose own
keys have the most members. Let a and b be the numbers of shingles that only the hub
and only a member has, and w = 5a + 4b. A member is similar to a hub of h shingles if
w <= h. Two members x and y, of which x is not, can only be similar if they have at
least (w_x + w_y - h) / 9 of these differences in common; that is more than w_y / 9.
So one of them is among all but w_y // 9 of those of y, of which the rarest are taken
(prefix filter; Chaudhuri et al., 2006). Pairs are those that meet there and have
enough differences in common: what a large group of near copies shares, which is the
hub's, pairs nobody. No pair of different components that meet under a key is left out.

Defined results: texts of fewer words than a shingle are one shingle; null and
empty texts have none and are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm import simhash_dedup
from traceloom.llm.shared import cut, map_arrow, min_components, scratch_path, scratch_scope

WIDTH = 5
BANDS, DEPTH = 32, 4
#: Minimum hashes of a sketch, which has 4 bits of each, and the places in which sketches of similar sets differ at most: at
#: 0.8 they differ in 96, with a standard deviation of 9.
HASHES, APART, SIMILARITY = 512, 143, 0.8
#: Words of 64 bits of a sketch.
SKETCH = HASHES // 16
#: Members of a key that are paired with each other at once; the others are held against a hub.
SMALL = 16
#: Shingles whose minimum hashes are taken at once; bounds the memory that one long text takes.
SLICE = 1_000
_RNG = np.random.default_rng(42)
_FACTOR, _SHIFT = (_RNG.integers(1, 2**63, HASHES, dtype=np.uint64) for _ in range(2))
_FACTOR |= np.uint64(1)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the text's distinct word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype=np.uint64))


def keys_and_sketch(shingles: np.ndarray) -> tuple[list[int], list[int]]:
    """The keys of a set, one for each band, and its sketch."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(shingles), SLICE):
        np.minimum(least, (shingles[lo : lo + SLICE, None] * _FACTOR + _SHIFT).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(part.tobytes(), seed=k) - 2**63 for k, part in enumerate(least[: BANDS * DEPTH].reshape(BANDS, DEPTH))]
    # Bits below those that the order of minima depends on.
    part = (least >> np.uint64(32) & np.uint64(15)).reshape(SKETCH, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return keys, np.bitwise_or.reduce(part, axis=1).view(np.int64).tolist()


def similar(a: str | None, b: str | None) -> bool:
    x, y = shingle_set(a), shingle_set(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    either = len(x) + len(y) - both
    return either == 0 or both / either >= SIMILARITY


def signatures(rows: DataFrame) -> DataFrame:
    """(row, set, size, keys, sketch) of rows (row, text): the set's digest, its size, keys and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
            keys, sketches = zip(*(keys_and_sketch(s) if len(s) else ([], []) for s in sets)) if sets else ((), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64())),
                ],
                names=["row", "set", "size", "keys", "sketch"],
            )

    return map_arrow(rows.select("row", F.col("text").cast("string").alias("text")), run, "row bigint, set binary, size int, keys array<bigint>, sketch array<bigint>")


def with_texts(spark: SparkSession, pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b, s, t): pairs (a, b) of rows with their texts."""
    asked = pairs.select(F.col("a").alias("row")).distinct().unionByName(pairs.select(F.col("b").alias("row")).distinct()).distinct()
    texts = cut(spark, rows.select("row", F.col("text").cast("string").alias("text")).join(asked, "row", "left_semi"), "pair-texts")
    held = pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("s")), "a").join(texts.select(F.col("row").alias("b"), F.col("text").alias("t")), "b")
    return held.select("a", "b", "s", "t")


def check_pairs(spark: SparkSession, pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            yield batch.select([0, 1]).filter(pa.array([similar(s, t) for s, t in zip(x, y)], pa.bool_()))

    return cut(spark, map_arrow(with_texts(spark, pairs, rows), run, "a bigint, b bigint"), "links")


def differences(spark: SparkSession, family: DataFrame, rows: DataFrame) -> DataFrame:
    """(hub, node, w, h, apart) of family (hub, node): apart holds the shingles of one of both only, odd if they are the node's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, h, apart = [], [], []
            for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = shingle_set(s), shingle_set(t)
                gone, new = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                w.append(5 * len(gone) + 4 * len(new))
                h.append(len(x))
                apart.append(np.r_[new | np.uint64(1), gone & ~np.uint64(1)].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(w, pa.int64()), pa.array(h, pa.int64()), pa.array(apart, pa.list_(pa.int64()))], names=["hub", "node", "w", "h", "apart"]
            )

    held = with_texts(spark, family.select(F.col("hub").alias("a"), F.col("node").alias("b")), rows)
    return cut(spark, map_arrow(held, run, "hub bigint, node bigint, w bigint, h bigint, apart array<bigint>"), "differences")


def common_differences(spark: SparkSession, apart: DataFrame) -> DataFrame:
    """(hub, node, w, h, shared, first): the differences that another member of the hub has too, and those of them that a similar member must meet."""
    one = apart.select("hub", "node", F.explode("apart").alias("d"))
    counts = one.groupBy("hub", "d").agg(F.count("*").alias("n")).where("n > 1")
    shared = one.join(counts, ["hub", "d"]).groupBy("hub", "node").agg(F.array_sort(F.collect_list(F.struct("n", "d"))).alias("shared"))
    # The rarest are first: those that no other member has, then the shared ones by their number.
    first = F.greatest(F.size("shared") - F.floor(F.col("w") / 9), F.lit(0)).cast("int")
    return cut(spark, apart.join(shared, ["hub", "node"]).select("hub", "node", "w", "h", F.col("shared.d").alias("shared"), F.slice("shared.d", 1, first).alias("first")), "common")


def fingerprint_pairs(spark: SparkSession, rows: DataFrame, signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes: each row that simhash_dedup groups, and its group's smallest row."""
    found = simhash_dedup.near_duplicates(spark, rows, id_col="row", width=WIDTH)
    node = signed.select("row", "set").join(nodes.select("set", "node"), "set").select("row", "node")
    grouped = found.where("id <> component_id").select(F.col("id").alias("row"), F.col("component_id").alias("least"))
    both = grouped.join(node, "row").join(node.select(F.col("row").alias("least"), F.col("node").alias("other")), "least")
    return both.where("node <> other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def groups(spark: SparkSession, rows: DataFrame, small: int = SMALL) -> DataFrame:
    """(row, component) of every row of rows (row, text); component is the smallest row of its group.

    Two numbers a row are written; the tables that led to them go.
    """
    path = scratch_path(spark, "near-groups")
    with scratch_scope(spark):
        out = _groups(spark, rows, small)
        out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def families(spark: SparkSession, shared: DataFrame, rows: DataFrame, small: int) -> DataFrame:
    """(hub, node): the members of keys (key, node, n) of more than `small`, each with the key's hub, of which it is not one."""
    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    many = shared.where(F.col("n") > small).select("key", "node")
    ranked = many.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", F.xxhash64("node").alias("by"), "node")).alias("lead"))
    met = cut(spark, many.join(cut(spark, ranked, "leads"), "key").select("lead", "node").distinct(), "led")
    # A lead that is similar to another one of more weight leaves its keys to it, so that one group has few hubs.
    leads = met.select(F.col("lead.node").alias("b")).distinct()
    other = cut(spark, met.select("lead", F.col("lead.node").alias("a"), F.col("node").alias("b")).where("a <> b").join(leads, "b", "left_semi"), "other-leads")
    above = other.join(check_pairs(spark, other.select("a", "b"), rows), ["a", "b"]).groupBy("b").agg(F.max("lead").alias("above"))
    led = met.select(F.col("lead.node").alias("b"), "node").join(cut(spark, above, "above"), "b", "left")
    return cut(spark, led.select(F.coalesce("above.node", "b").alias("hub"), "node").where("hub <> node").distinct(), "families")


def _groups(spark: SparkSession, rows: DataFrame, small: int = SMALL) -> DataFrame:
    signed = cut(spark, signatures(rows), "signatures")
    nodes = cut(spark, signed.groupBy("set").agg(F.min("row").alias("node"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "sets")
    words = [f"w{k}" for k in range(SKETCH)]
    # Keys that several sets share are found by themselves, before sketches are joined to them; what is joined is
    # written first, so that a large key's rows can be split.
    spots = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    counts = cut(spark, spots.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key-sizes")
    shared = cut(spark, spots.join(counts, "key"), "shared-keys")
    # Of a key, 32 bits tell whether another text has the same one.
    tags = F.transform("keys", lambda k: F.shiftright(k, 32).cast("int"))
    marked = nodes.select("node", "size", tags.alias("tags"), *(F.get("sketch", F.lit(k)).alias(w) for k, w in enumerate(words)))
    few = cut(spark, shared.where(F.col("n") <= small).join(marked, "node"), "keys")

    def fitting(a: DataFrame, b: DataFrame) -> DataFrame:
        # Sizes alone bound the similarity.
        x, y = a.alias("x"), b.alias("y")
        ones = F.lit(0x1111111111111111)
        either = lambda v: v.bitwiseOR(F.shiftrightunsigned(v, 2))
        apart = F.lit(0)
        for w in words:
            v = either(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}")))
            apart = apart + F.bit_count(v.bitwiseOR(F.shiftrightunsigned(v, 1)).bitwiseAND(ones))
        close = (F.least("x.size", "y.size") >= F.greatest("x.size", "y.size") * SIMILARITY - 1e-6) & (apart <= APART)
        here = F.array_position(F.zip_with("x.tags", "y.tags", lambda s, t: s == t), True) == F.col("x.band") + 1
        return x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & close & here).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    pairs = cut(spark, fitting(few, few).unionByName(fingerprint_pairs(spark, rows, signed, nodes)).distinct(), "pairs")
    links = check_pairs(spark, pairs, rows)
    apart = differences(spark, families(spark, shared, rows, small), rows)
    links = links.unionByName(apart.where("w <= h").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")))
    found = cut(spark, min_components(spark, links), "components")
    left, tested, most = common_differences(spark, apart), pairs, 4 * small
    while not left.isEmpty():
        hubs = found.select(F.col("node").alias("hub"), F.col("component").alias("main"))
        own = left.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).join(hubs, "hub", "left")
        own = cut(spark, own.withColumn("outside", F.col("component") != F.coalesce("main", "hub")).drop("main"), "labelled")
        minor = cut(spark, own.where("outside").groupBy("hub").agg(F.count("*").alias("minor")), "minor")
        own = own.join(minor, "hub")
        # Of a hub's members outside its component, which are not similar to it, about `most` are compared with all others.
        chosen = F.col("outside") & (F.pmod(F.xxhash64("node", F.lit(most)), F.ceil(F.col("minor") / most)) == 0)
        x = own.where(chosen).select("hub", F.col("node").alias("x"), (F.col("w") - F.col("h")).alias("over"), F.col("component").alias("of"), F.explode("shared").alias("d"))
        y = own.select("hub", F.col("node").alias("y"), "w", "component", F.explode("first").alias("d"))
        met = x.join(y, ["hub", "d"]).where("of <> component").groupBy("hub", "x", "y", "over", "w").agg(F.count("*").alias("n"))
        # Those of y that are not asked are w // 9 at most.
        asked = met.where(F.col("n") + F.floor(F.col("w") / 9) >= (F.col("over") + F.col("w")) / 9)
        asked = asked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        asked = cut(spark, asked, "pairs")
        if not asked.isEmpty():
            links = links.unionByName(check_pairs(spark, asked, rows))
            tested = tested.unionByName(asked)
            found = cut(spark, min_components(spark, links), "components")
        left, most = cut(spark, own.where(~chosen).select("hub", "node", "w", "h", "shared", "first"), "left-members"), 4 * most
    named = nodes.select("set", "node").join(found, "node", "left")
    return signed.select("row", "set").join(named.select("set", F.coalesce("component", "node").alias("component")), "set").select("row", "component")
