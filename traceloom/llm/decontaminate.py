"""Benchmark decontamination by template canonicalisation.

Numbers, names and units are replaced by typed placeholders, a run of names by
one, so that a question with other parameters keeps its template. Windows of template tokens of the
documents are hash-joined to those of the benchmark; for each alignment of a
document with an item the slots must be consistent: equal values of the item
stand for equal values of the document. A pair is reported if its consistent
windows cover enough of the item. Windows whose slots hold the item's own values
are evidence whatever the alignment's other windows say.

Short items, and windows of few plain words, are matched by their tokens with
all values instead. One of under `least_words` tokens says too little inside a text
if it has under SHORT_BYTES bytes, or SHORT_WORDS_BYTES in three words or more: it
then matches only a document that has no other token.

A bitmap of the benchmark's window hashes, of bounded size, tells the scan which
windows can match; only these leave it.

Items of one text are looked for once and named at the end.

Defined results: null or empty texts match nothing; rows that repeat are reported
each, as are items that repeat; a null id is kept; an item shorter than a window
is one window; a window that many items share counts for each of them; very long
texts are read in whole, in chunks of whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm.shared import cut, map_arrow

WIDTH = 8
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?:;\n]+")
#: Units that stand for one slot after a number (fixed values).
UNITS = frozenset(
    "mm cm m km in inch inches ft feet foot yard yards mile miles mg g kg t ton tons lb lbs oz ml cl l litre litres liter liters gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent usd eur dollar dollars euro euros "
    "cent cents degree degrees kmh mph w kw v j kj cal hz khz mhz gb mb kb stunde stunden tag tage woche wochen jahr jahre heure heures jour jours "
    "semaine semaines an ans hora horas dia dias semana semanas mes meses".split()
)
WORD, NAME, NUMBER, UNIT, END = range(5)
#: Bytes of a short item's tokens from which on it is looked for within documents: of any, and of three tokens or more.
SHORT_BYTES, SHORT_WORDS_BYTES = 20, 12
#: Tells hashes of tokens with their values from those of templates.
RAW = np.uint64(0x5851F42D4C957F2D)
#: Bits of the bitmap at most (8 MB).
MAX_BITS = 1 << 26


class Canonical:
    """Turns texts into template tokens: hashes, kinds and, for slots, values.

    Words seen are kept, up to MAX_WORDS, with their hash and kind.
    """

    MAX_WORDS = 150_000

    def __init__(self) -> None:
        self.slot = np.array([xxhash.xxh64_intdigest(f"<{k}>") for k in ("word", "name", "number", "unit")], dtype=np.uint64)
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.names: list[str] = []
        self.hashes, self.kinds = np.empty(0, np.uint64), np.empty(0, np.int8)

    def _learn(self, new: list[str]) -> None:
        lower = [t.lower() for t in new]
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
        self.names += lower
        self.hashes = np.r_[self.hashes, np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in lower], dtype=np.uint64)]
        self.kinds = np.r_[self.kinds, np.array(list(map(_kind, new, lower)), dtype=np.int8)]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the template tokens of all texts: hash, kind (WORD where no slot), place in names, and text."""
        found = [TOKEN.findall(t) for t in texts]
        if new := set().union(*found).difference(self.at):
            if len(self.at) > self.MAX_WORDS:
                self._clear()
                new = set().union(*found)
            self._learn(sorted(new))
        sizes = [len(f) for f in found]
        own = np.fromiter(map(self.at.__getitem__, chain.from_iterable(found)), dtype=np.int64, count=sum(sizes))
        doc = np.repeat(np.arange(len(texts)), sizes)
        kinds = self.kinds[own]
        # A capital at a sentence's start does not make a name; a unit needs a number before it.
        before = np.r_[np.int8(END), kinds[:-1]] if len(kinds) else kinds
        before[np.r_[True, doc[1:] != doc[:-1]] if len(doc) else []] = END
        kinds = np.where((kinds == NAME) & (before == END) | (kinds == UNIT) & (before != NUMBER), WORD, kinds)
        keep = kinds != END
        own, kinds, doc = own[keep], kinds[keep], doc[keep]
        return np.where(kinds == WORD, self.hashes[own], self.slot[kinds]), kinds, own, doc


def _kind(token: str, lower: str) -> int:
    if token[0].isdigit():
        return NUMBER
    if not token[0].isalpha():
        return END
    if lower in UNITS:
        return UNIT
    return NAME if token[0].isupper() and len(token) > 1 and not token.isupper() else WORD


def chunks(texts: list, most: int = 300_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `most` code points."""
    lo = size = 0
    for k, t in enumerate(texts):
        if k > lo and size + len(t) > most:
            yield lo, k
            lo, size = k, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def window_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of each run of `width` tokens."""
    n = len(tokens) - width + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    if n > 0:
        with np.errstate(over="ignore"):
            for k in range(width):
                out = out * np.uint64(0x9E3779B97F4A7C15) + tokens[k : k + n]
            out ^= out >> np.uint64(31)
            out *= np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(29)
            out += np.uint64(width)
    return out


_WINDOWS = "key bigint, id {id}, pos int, hash bigint, slots array<string>, n_tokens int, width int, at int, span int"


def merged_names(kinds: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the tokens of a template start and end: a run of names of one text is one of them."""
    again = np.zeros(len(kinds), dtype=bool)
    again[1:] = (kinds[1:] == NAME) & (kinds[:-1] == NAME) & (doc[1:] == doc[:-1])
    first = np.flatnonzero(~again)
    return first, np.r_[first[1:], len(kinds)] if len(kinds) else first


def too_short(values: list[str]) -> bool:
    """Whether a short item says too little to be looked for within a text."""
    size = sum(len(v.encode("utf-8", "surrogatepass")) for v in values)
    return size < (SHORT_WORDS_BYTES if len(values) > 2 else SHORT_BYTES)


def windows(rows: DataFrame, id_col: str, text_col: str, widths: tuple[tuple[int, bool], ...] | None, bitmap: np.ndarray | None, width: int, least_words: int) -> DataFrame:
    """Windows of template tokens, and raw ones of all tokens: (key, id, pos, hash, slots, n_tokens, width, at, span).

    Of an item (widths is None) all windows, or the whole item if it is shorter;
    those that a template cannot tell are raw: hash and slots are of all tokens,
    and each slot starts with "=". Of a document, the windows of each of the
    widths, raw or not, whose hash is in the bitmap.
    key tells rows apart: the task and the place in its input. pos and width count
    the window's own tokens, at and span all tokens, as n_tokens does.
    """
    source = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = _WINDOWS.format(id=dict(source.dtypes)["id"])
    bits = 0 if bitmap is None else len(bitmap) * 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical, context = Canonical(), TaskContext.get()
        row = (context.partitionId() if context else 0) << 40
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in chunks(texts):
                tokens, kinds, own, doc = canonical(texts[lo:hi])
                first, last = merged_names(kinds, doc)
                sizes = np.bincount(doc, minlength=hi - lo)
                parts = np.bincount(doc[first], minlength=hi - lo)
                starts = np.cumsum(sizes) - sizes
                all_widths = widths if widths is not None else sorted({(min(width, n), raw) for raw, of in ((False, parts), (True, sizes)) for n in of.tolist() if n})
                at: list[int] = []
                cols: list[list] = [[] for _ in range(8)]
                streams: dict[bool, tuple] = {}
                for w, raw in all_widths:
                    if raw not in streams:
                        # Templates or raw: hashes, kinds, texts, sizes, begins, and where tokens lie among all.
                        every = np.arange(len(doc)) if raw else None
                        streams[raw] = (canonical.hashes[own] ^ RAW, kinds, doc, sizes, starts, every, every + 1) if raw else (tokens[first], kinds[first], doc[first], parts, np.cumsum(parts) - parts, first, last)
                    hashes, kind, text, n, begins, begin, end = streams[raw]
                    h = window_hashes(hashes, w)
                    if bitmap is not None:
                        # A document's windows are few after the bitmap; that they say enough is known from the item's.
                        a = h & np.uint64(bits - 1)
                        place = np.flatnonzero(bitmap[a >> np.uint64(6)] >> (a & np.uint64(63)) & np.uint64(1))
                        b = (h[place] >> np.uint64(17)) & np.uint64(bits - 1)
                        place = place[(bitmap[b >> np.uint64(6)] >> (b & np.uint64(63)) & np.uint64(1)).astype(bool)]
                        place = place[text[place] == text[place + w - 1]]
                    else:
                        words = np.r_[0, np.cumsum(kind == WORD)]
                        ok = (text[: len(h)] == text[w - 1 :][: len(h)]) & (np.minimum(width, n[text[: len(h)]]) == w)
                        # Placeholders alone say nothing.
                        told = words[w:][: len(h)] - words[: len(h)] >= min(3, w)
                        if raw:
                            ok &= ~(told & (np.minimum(width, parts[text[: len(h)]]) >= least_words))
                        else:
                            ok &= told & (w >= least_words)
                        place = np.flatnonzero(ok)
                    for p in place.tolist():
                        d, lead, stop = int(text[p]), int(begin[p]), int(end[p + w - 1])
                        if raw:
                            values = [canonical.names[k] for k in own[lead:stop].tolist()]
                            if w < least_words and sizes[d] != w and too_short(values):
                                continue
                            values = [f"={v}" for v in values]
                        else:
                            values = [
                                f"{kind[j]}:{' '.join(canonical.names[k] for k in own[begin[j] : end[j]].tolist())}" for j in range(p, p + w) if kind[j] != WORD
                            ]
                        at.append(lo + d)
                        for c, v in zip(cols, (row + lo + d, p - int(begins[d]), int(h[p]), values, int(sizes[d]), w, lead - int(starts[d]), stop - lead)):
                            c.append(v)
                if at:
                    numbers = [pa.array(c, pa.int32()) for c in cols[4:]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(cols[0], pa.int64()), batch.column(0).take(pa.array(at, pa.int64())), pa.array(cols[1], pa.int32()),
                            pa.array(np.array(cols[2], dtype=np.uint64).view(np.int64)), pa.array(cols[3], pa.list_(pa.string())), *numbers,
                        ],
                        names=["key", "id", "pos", "hash", "slots", "n_tokens", "width", "at", "span"],
                    )
            row += len(texts)

    return map_arrow(source, run, schema)


def hash_bitmap(index: DataFrame, n: int) -> np.ndarray:
    """Two bits for each hash in a bitmap of 64 bits a window or MAX_BITS, built by bit_or on the executors.

    Its words come to the driver as Arrow columns, of 16 MB at most.
    """
    bits = 1 << 12
    while bits < min(64 * n, MAX_BITS):
        bits <<= 1
    # Unsigned remainder of a signed bigint by a power of two is its low bits.
    low = F.explode(F.array(F.col("hash"), F.shiftrightunsigned("hash", 17))).alias("h")
    spot = index.select(low).select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("b"))
    words = spot.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words["w"].to_numpy()] = words["v"].to_numpy()
    return out.view(np.uint64)


def contaminated(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
    width: int = WIDTH, coverage: float = 0.5, template_coverage: float = 0.7, enough: int = 25, least_words: int = 5,
) -> DataFrame:
    """(key, id, item_id, coverage, covered_tokens, kind) of the pairs reported.

    kind is "exact" if every slot of an alignment's windows holds the item's value,
    or the windows whose slots do cover enough by themselves; else it is
    "reparameterised". A pair is reported if consistent windows cover the share
    `coverage` of the item's tokens, or `enough` tokens; where slots differ, which
    says less, the share must be `template_coverage`.
    """
    named = benchmark.select(F.col(item_col).alias("item_id"), F.col("text").cast("string").alias("item_text")).where("item_text <> ''")
    texts = cut(spark, named.select("item_text").distinct().withColumn("item_key", F.monotonically_increasing_id()), "item-texts")
    items = cut(spark, windows(texts, "item_key", "item_text", None, None, width, least_words), "item-windows")
    # An item's repeated windows count once; its rows are few beside the documents'.
    items = items.groupBy(F.col("id").alias("item_key"), "hash", "n_tokens", "width").agg(F.min(F.struct("pos", "slots", "at", "span")).alias("first"))
    items = items.select(
        "item_key", "hash", "width", F.col("first.pos").alias("item_pos"), F.col("first.slots").alias("item_slots"), F.col("first.at").alias("item_at"),
        F.col("first.span").alias("item_span"), F.col("n_tokens").alias("item_tokens"),
    )
    raw = F.coalesce(F.get("item_slots", F.lit(0)).startswith("="), F.lit(False))
    sizes = items.groupBy("width", raw.alias("raw")).agg(F.count("*").alias("n")).collect()
    if not sizes:
        widths, bitmap = ((width, False),), np.zeros(1, dtype=np.uint64)
    else:
        widths = tuple(sorted((r["width"], r["raw"]) for r in sizes))
        bitmap = hash_bitmap(items, sum(r["n"] for r in sizes))
    found = windows(docs, id_col, text_col, widths, bitmap, width, least_words)
    held = F.col("slots") == F.col("item_slots")
    pairs = found.join(items, ["hash", "width"]).where((F.size("slots") == F.size("item_slots")) & (held | ~raw))
    slots = F.arrays_zip(F.col("item_slots").alias("item"), F.col("slots").alias("own"))
    spot = F.struct("item_at", "item_span")
    aligned = pairs.groupBy("key", "id", "item_key", "item_tokens", raw.alias("raw"), (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        F.collect_set(spot).alias("spots"), F.collect_set(F.when(held, spot)).alias("held"), F.array_distinct(F.flatten(F.collect_set(slots))).alias("slots")
    )
    consistent = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["item"])))
    aligned = aligned.where(consistent | (F.size("held") > 0))
    same = consistent & F.forall("slots", lambda s: s["item"] == s["own"])
    joined = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    whole = aligned.groupBy("key", "id", "item_key", "item_tokens").agg(
        joined(F.when(consistent, F.col("spots")).otherwise(F.col("held"))).alias("spots"), joined("held").alias("held"), F.bool_or(same).alias("exact")
    )
    covered = lambda spots: F.aggregate(
        spots,
        F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["upto"], s["item_at"] + s["item_span"]).alias("upto"),
            (acc["n"] + F.greatest(F.lit(0), s["item_at"] + s["item_span"] - F.greatest(acc["upto"], s["item_at"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    whole = whole.withColumns({"covered_tokens": covered("spots"), "held_tokens": covered("held")})
    sufficient = lambda n: (F.col(n) / F.col("item_tokens") >= coverage) | (F.col(n) >= enough)
    out = whole.withColumn("exact", F.col("exact") | sufficient("held_tokens"))
    out = out.select("key", "id", "item_key", "covered_tokens", "item_tokens", F.when(F.col("exact"), "exact").otherwise("reparameterised").alias("kind"))
    out = out.withColumn("coverage", F.col("covered_tokens") / F.col("item_tokens"))
    out = out.where((F.col("kind") == "exact") & sufficient("covered_tokens") | (F.col("coverage") >= template_coverage))
    owners = named.join(texts, "item_text").select("item_key", "item_id")
    return out.join(owners, "item_key").select("key", "id", "item_id", "covered_tokens", "kind", "coverage")
