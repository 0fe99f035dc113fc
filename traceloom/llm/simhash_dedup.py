"""SimHash near-duplicates by the generalised pigeonhole principle.

Each text gets a 64-bit fingerprint; documents whose fingerprints differ in at
most ``radius`` bits are linked, and linked documents form groups. The 64 bits
are split into m parts with thresholds that sum to radius - m + 1, so that two
linked fingerprints are within its threshold in one part at least. Correlated
bits are put in the same part and the thresholds are allocated by dynamic
programming on estimated candidate counts (Qin et al., "GPH: similarity search
in Hamming space", ICDE 2018).

Defined results: a null text counts as empty, an empty text has fingerprint zero
and is linked like any other; rows that repeat are kept, each with its group; a
null id never names a group unless all of the group's ids are null; further
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm.shared import cut, map_arrow, min_components

BITS = 64
#: Shingles hashed at once; bounds the memory that one long text takes.
SLICE = 200_000


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit majority fingerprint of the text's word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    total, ones = max(1, len(words) - width + 1), np.zeros(BITS, dtype=np.int64)
    for lo in range(0, total, SLICE):
        n = min(SLICE, total - lo)
        part = words[lo : lo + n + width - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype="<u8", count=n)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): fp holds the unsigned fingerprint's bits as a signed bigint."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = source.select("id", F.lit(0).cast("bigint").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return map_arrow(source, run, schema)


@dataclass(frozen=True)
class Part:
    """Bits of one part, and within how many of them candidates must agree."""

    bits: tuple[int, ...]
    threshold: int


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, share of ones of each bit, and correlation of each pair of bits.

    Each task reduces its rows to 64 x 64 counts, so that the driver gets 4,096
    sums whatever the input's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo in range(0, len(x), 20_000):
                b = np.unpackbits(x[lo : lo + 20_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += b.T @ b
            n += len(x)
        if n:
            cells = np.append(both.reshape(-1), n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "n"])

    sums = map_arrow(fps.select("fp"), run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1)
    for r in sums:
        cells[r["cell"]] = r["n"]
    n = int(cells[-1])
    both = cells[:-1].reshape(BITS, BITS) / max(n, 1)
    p = both.diagonal().copy()
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    return n, p, (both - np.outer(p, p)) / np.outer(spread, spread)


def group_bits(correlation: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """Split the bits into m parts of near equal size, correlated bits together."""
    c, left, parts = np.abs(correlation), list(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        if k == m - 1:
            parts.append(tuple(left))
            break
        first = max(left, key=lambda i: (c[i, left].sum(), -i))
        own = [first]
        while len(own) < size:
            own.append(max((i for i in left if i not in own), key=lambda i: (c[i, own].mean(), -i)))
        left = [i for i in left if i not in own]
        parts.append(tuple(sorted(own)))
    return parts


def candidate_share(p: np.ndarray, bits: tuple[int, ...], most: int) -> np.ndarray:
    """Estimated share of pairs that differ in at most t of the bits, for t = 0 to most."""
    law = np.zeros(most + 2)
    law[0] = 1.0
    for b in bits:
        differ = 2 * p[b] * (1 - p[b])
        law[1:] = law[1:] * (1 - differ) + law[:-1] * differ
        law[0] *= 1 - differ
    return np.cumsum(law[: most + 1])


def probes(width: int, threshold: int) -> int:
    """Keys that a fingerprint of so many bits is looked up by."""
    count, step = 0, 1
    for k in range(threshold + 1):
        count, step = count + step, step * (width - k) // (k + 1)
    return count


def allocate(p: np.ndarray, correlation: np.ndarray, n: int, radius: int = 3, pair_cost: float = 0.02) -> list[Part]:
    """Parts and thresholds of least estimated cost.

    The cost of a part at threshold t is its probing keys per fingerprint plus
    pair_cost for each candidate that they meet; at t = -1 it is not probed. For
    each number of parts, a dynamic programme over (part, sum so far) finds the
    allocation of the sum radius - m + 1.
    """
    best: tuple[float, list[Part]] | None = None
    for m in range(2, radius + 2):
        parts = group_bits(correlation, m)
        target = radius - m + 1
        cost = []
        for bits in parts:
            share = candidate_share(p, bits, radius)
            cost.append([0.0] + [probes(len(bits), t) + pair_cost * n * share[t] / 2 for t in range(radius + 1)])
        states: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for row in cost:
            after: dict[int, tuple[float, tuple[int, ...]]] = {}
            for total, (value, chosen) in states.items():
                for t in range(-1, radius + 1):
                    new = (value + row[t + 1], chosen + (t,))
                    if total + t not in after or new < after[total + t]:
                        after[total + t] = new
            states = after
        value, chosen = states[target]
        if best is None or value < best[0]:
            best = (value, [Part(b, t) for b, t in zip(parts, chosen) if t >= 0])
    assert best is not None
    return best[1]


def _mask(bits: tuple[int, ...]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def probe_keys(fps: DataFrame, parts: list[Part]) -> DataFrame:
    """(fp, path, key, mask): a row for each part and each key that its threshold allows.

    The key is the fingerprint's bits under the mask, with up to threshold of them
    flipped; two fingerprints within the threshold meet at the own key of each.
    """
    out = None
    for k, part in enumerate(parts):
        mask = _mask(part.bits)
        flips = [0] + [_mask(c) for t in range(1, part.threshold + 1) for c in combinations(part.bits, t)]
        one = fps.select("fp", F.explode(F.array(*(F.lit(_signed(x)) for x in flips))).alias("flip")).select(
            "fp",
            F.lit(str(k)).alias("path"),
            F.col("fp").bitwiseAND(F.lit(_signed(mask))).bitwiseXOR(F.col("flip")).alias("key"),
            F.lit(_signed(mask)).alias("mask"),
        )
        out = one if out is None else out.unionByName(one)
    return out


#: Rows whose finer keys are made at once.
SPLIT_ROWS = 5_000
#: Fingerprints under one key that one task compares at once.
LIMIT = 2048

_ROWS = "fp bigint, path string, key bigint, mask bigint"


def split_keys(rows: DataFrame, radius: int) -> DataFrame:
    """Members of a key by finer keys, so that each pair within radius still meets.

    The bits outside the key are cut into blocks; a pair within radius differs in
    at most radius of them, so it agrees on all others for one choice at least.
    """
    choices = [set(c) for c in combinations(range(2 * radius), radius)]
    schema = pa.schema([("fp", pa.int64()), ("path", pa.string()), ("key", pa.int64()), ("mask", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finer: dict[int, np.ndarray] = {}
        for batch in batches:
            path = batch.column("path").dictionary_encode()
            codes = path.indices.to_numpy(zero_copy_only=False)
            fp, key, mask = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("fp", "key", "mask"))
            # A path has one mask.
            for code, name in enumerate(path.dictionary.to_pylist()):
                own = np.flatnonzero(codes == code)
                if not len(own):
                    continue
                m = int(mask[own[0]])
                if m not in finer:
                    left = [b for b in range(BITS) if not (m >> b) & 1]
                    blocks = [list(map(int, x)) for x in np.array_split(np.array(left), 2 * radius)]
                    finer[m] = np.array([_signed(_mask(tuple(b for k, block in enumerate(blocks) if k not in c for b in block))) for c in choices], dtype=np.int64)
                fine = finer[m]
                names = pa.array([f"{name}.{k}" for k in range(len(fine))])
                for lo in range(0, len(own), SPLIT_ROWS):
                    at = own[lo : lo + SPLIT_ROWS]
                    ways = pa.array(np.tile(np.arange(len(fine), dtype=np.int32), len(at)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(fp[at], len(fine))), pa.DictionaryArray.from_arrays(ways, names).cast(pa.string()),
                            pa.array((key[at, None] | (fp[at, None] & fine)).ravel()), pa.array(np.tile(m | fine, len(at))),
                        ],
                        schema=schema,
                    )

    return map_arrow(rows.select("fp", "path", "key", "mask"), run, _ROWS)


def _links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the fingerprints of one key."""
    fps = np.unique(fps)
    n = len(fps)
    root = list(range(n))
    edges: list[tuple[int, int]] = []
    u = fps.view(np.uint64)
    step = max(1, 250_000 // max(n, 1))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for lo in range(0, n, step):
        i, j = np.nonzero(np.bitwise_count(u[lo : lo + step, None] ^ u[None, :]) <= radius)
        i = i + lo
        for x, y in zip(i[i < j].tolist(), j[i < j].tolist()):
            a, b = top(x), top(y)
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((int(fps[x]), int(fps[y])))
    return edges


def verify(rows: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) among the members of each key; no pair beyond a forest of each key is emitted."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last: tuple | None = None

        def flush() -> list[tuple[int, int]]:
            fps = np.concatenate(held) if held else np.empty(0, np.int64)
            held.clear()
            return _links(fps, radius) if len(fps) > 1 else []

        def made(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            a, b = zip(*edges)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column("path").dictionary_encode()
            names = path.dictionary.to_pylist()
            codes = path.indices.to_numpy(zero_copy_only=False)
            key = batch.column("key").to_numpy(zero_copy_only=False)
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (codes[1:] != codes[:-1])])
            edges: list[tuple[int, int]] = []
            for s, e in zip(starts.tolist(), np.r_[starts[1:], len(key)].tolist()):
                here = (names[codes[s]], int(key[s]))
                if here != last:
                    edges += flush()
                    last = here
                if e - s > 1 or e == len(key) or held:
                    held.append(fp[s:e])
            if edges:
                yield made(edges)
        if edges := flush():
            yield made(edges)

    dealt = rows.select("fp", "path", "key").repartition("path", "key").sortWithinPartitions("path", "key")
    return map_arrow(dealt, run, "a bigint, b bigint")


def fingerprint_links(spark: SparkSession, distinct: DataFrame, radius: int = 3, limit: int = LIMIT) -> DataFrame:
    """Links among distinct fingerprints (column fp) that join all that are within radius.

    Keys with more than `limit` members are split by further bits until none is
    larger, or until at most 2^12 fingerprints can share a key.
    """
    n, p, correlation = bit_statistics(distinct)
    if n < 2:
        return spark.createDataFrame([], "a bigint, b bigint")
    rows = probe_keys(distinct, allocate(p, correlation, n, radius))
    links = None
    while True:
        sizes = rows.groupBy("path", "key", "mask").agg(F.count("*").alias("n"))
        large = sizes.where((F.col("n") > limit) & (F.bit_count("mask") < BITS - 12)).select("path", "key")
        large = cut(spark, large, "large-keys")
        some = not large.isEmpty()
        found = verify(rows.join(large, ["path", "key"], "left_anti") if some else rows, radius)
        links = found if links is None else links.unionByName(found)
        if not some:
            return links
        rows = cut(spark, split_keys(rows.join(large, ["path", "key"], "left_semi"), radius), "split-keys")


def near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = 3,
    width: int = 3,
    limit: int = LIMIT,
) -> DataFrame:
    """(id, fp, component_id) of every row of docs; component_id is the smallest id of its group."""
    fps = cut(spark, fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = cut(spark, fps.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    links = fingerprint_links(spark, distinct.select("fp"), radius, limit)
    groups = min_components(spark, links)
    groups = cut(spark, groups.withColumnRenamed("node", "fp"), "groups")
    named = distinct.join(groups, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    # Written first, so that a large group's rows can be split in the join.
    least = cut(spark, distinct.join(groups, "fp").groupBy("component").agg(F.min("least").alias("component_id")), "least")
    label = named.join(least, "component", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return fps.join(label, "fp").select("id", "fp", "component_id")
