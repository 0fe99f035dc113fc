"""Operators on documents against brute force, with nulls, empties, ties, repeats and empty tables."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from traceloom.llm import decontaminate, packing, quality_rules, sharding, simhash_dedup, toxicity
from traceloom.llm.shared import min_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, kept string"


def words(rng, n):
    return " ".join("".join(rng.choice(["th", "on", "er", "an", "re", "he"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = words(rng, 300)
    near = base.split()
    near[150] = "changed"
    out = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \t\n"), (7, "One"), (8, "one"), (9, "two words"), (10, "ÀÉ über Straße naïve ﬁ ½ ²"),
        (11, words(rng, 30_000)), (12, "a b c\na b c\na b c"), (12, "a b c\na b c\na b c"), (None, "no id here"), (None, base), (13, "x" * 50_000), (14, "line one\nline one\n\n \nline two"),
        (-5, "negative id"), (15, "<|endoftext|> special don't IT'S"), (16, "tab\x0bvertical\x0cfeed nbsp\u00a0stays\u2003too"),
    ]
    out += [(100 + k, words(rng, rng.randint(1, 400))) for k in range(60)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, (None, "en", "fr")[k % 3], (None, "s1", "s2", "s3")[k % 4], len(t or ""), 7, 0.5, "x") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# SimHash -----------------------------------------------------------------------------


def brute_fingerprint(text):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=3):
    root = {f: f for f in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    u = sorted(root)
    for i, a in enumerate(u):
        for b in u[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {f: top(f) for f in u}


def test_simhash_is_brute_force(spark, docs, texts):
    got = sorted(((r["id"] is None, r["id"] or 0, r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash_dedup.near_duplicates(spark, docs).collect()), key=str)
    fps = [(i, brute_fingerprint(t)) for i, t in texts]
    comp = brute_components({f for _, f in fps})
    least = {}
    for i, f in fps:
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    assert got == sorted(((i is None, i or 0, f, least.get(comp[f])) for i, f in fps), key=str)


@pytest.mark.parametrize("limit", [2048, 4])
def test_links_in_dense_groups_survive_splits(spark, limit):
    """Fingerprints around a few centres: keys over the limit are split, and no link is lost."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 3)
    fps = set()
    for c in centres.tolist():
        for _ in range(60):
            x = c
            for b in rng.choice(20, rng.integers(0, 5), replace=False).tolist():
                x ^= 1 << b * 3
            fps.add(x)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    links = simhash_dedup.fingerprint_links(spark, df, limit=limit).collect()
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 3 for r in links)
    got = {f: f for f in fps}

    def top(x):
        while got[x] != x:
            x = got[x]
        return x

    for r in links:
        a, b = top(r["a"]), top(r["b"])
        got[max(a, b)] = min(a, b)
    assert {f: top(f) for f in fps} == brute_components(fps)


def test_allocation_covers_every_pair():
    """Any thresholds that the programme picks meet the generalised pigeonhole bound."""
    p, c = np.full(64, 0.5), np.eye(64)
    for n in (10, 10**5, 10**8, 10**11):
        for radius in (1, 2, 3, 5):
            parts = simhash_dedup.allocate(p, c, n, radius)
            bits = sorted(b for q in parts for b in q.bits)
            assert len(bits) == len(set(bits))
            # The adversary spends threshold + 1 differences on each probed part.
            assert sum(q.threshold + 1 for q in parts) > radius


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in min_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + k: 100 for k in range(30)}


def test_simhash_of_nothing(spark, empty):
    assert simhash_dedup.near_duplicates(spark, empty).count() == 0


# Packing -------------------------------------------------------------------------------


def test_packing_round_trip(spark, docs, texts):
    rows = packing.pack(spark, docs, longest=64).collect()
    tokenizer = packing.default_tokenizer().tokenizer
    want = Counter()
    for i, t in texts:
        want[i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (2,)] += 1
    by_id = {}
    for r in rows:
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 64 and r["offset"] == 0 and r["length"] == len(r["ids"]) == 1 << r["bucket"]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        by_id.setdefault(r["id"], []).append(r)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for i, own in by_id.items():
        expected = sum(([(ids[s : s + n], s, len(ids)) for s, n in _pieces(ids)] * k for (j, ids), k in want.items() if j == i), [])
        assert sorted((tuple(r["ids"]), r["start"], r["doc_tokens"]) for r in own) == sorted(expected)
    assert by_id.keys() == {i for i, _ in texts}


def _pieces(ids):
    at = 0
    for n in packing.piece_lengths(len(ids), 64):
        yield at, n
        at += n


def test_piece_lengths():
    assert packing.piece_lengths(4096 * 2 + 5) == [4096, 4096, 4, 1] and packing.piece_lengths(0) == []
    with pytest.raises(ValueError):
        packing.piece_lengths(5, 100)


def test_tokens_are_the_tokenizers():
    w = packing.default_tokenizer()
    for c in map(chr, [*range(1, 0x250), 0x3A3, 0x130, 0x2028, 0xFB01, 0x1F600]):
        for s in (c, f"a{c}B", f"{c}'s", f"'{c}", f"{c}{c.upper()} {c}'LL"):
            assert np.frombuffer(next(w([s])), "<u4").tolist() == w.tokenizer.encode(s, add_special_tokens=False).ids, repr(s)


def test_packing_nothing(spark, empty):
    assert packing.pack(spark, empty).count() == 0


# Quality -----------------------------------------------------------------------------------


def brute_measures(text):
    text = text or ""
    flat = text.translate({ord(c): " " for c in "\t\n\x0b\x0c\r"})
    w = [x for x in flat.split(" ") if x]
    lines, seen, dup = [x for x in text.split("\n")], [], 0
    for x in lines:
        if x.strip(" \t\n\x0b\x0c\r"):
            dup += x in seen
            seen.append(x)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts = Counter(windows)
    marked = {i + k for i, x in enumerate(windows) if counts[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(marked)


def test_measures_are_brute_force(docs, texts):
    got = Counter(tuple(r)[:6] for r in quality_rules.measure(docs).collect())
    assert got == Counter((i, *brute_measures(t)) for i, t in texts if i != 11) + Counter((i, *quality_rules.measure_text(t)[:5]) for i, t in texts if i == 11)
    assert quality_rules.measure_text("a b c a b c")[:5] == (6, 6, 0, 0, 6)
    assert quality_rules.measure_text("#a b*c\nx\nx\n \n ")[2:4] == (2, 1)


def test_exact_bound():
    assert quality_rules.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert quality_rules.upper_bound(5, 50, 0.05) == pytest.approx(0.1997, abs=2e-3)
    assert quality_rules.upper_bound(3, 3, 0.05) == 1.0 and quality_rules.upper_bound(0, 0, 0.05) == 1.0


def test_rules_reject_junk_and_keep_their_promise(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        good = i % 5 != 0
        t = words(rng, 80) + "."
        rows.append((i, t if good else t.replace(" ", "*** "), "en" if i % 2 else "fr", None, 0, 0, 0.0, ""))
        labels.append((i, int(good)))
    docs, truth = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    out = {r["id"]: r for r in quality_rules.apply_rules(spark, docs, truth).collect()}
    assert all(not out[i]["base_failed"] for i in out)
    assert sum(out[i]["kept"] for i, g in labels if g) >= 0.95 * 720 and not any(out[i]["kept"] for i, g in labels if not g)
    unlabelled = quality_rules.apply_rules(spark, docs, truth.limit(0))
    assert unlabelled.where("not kept").count() == 0


def test_quality_of_edges(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    assert quality_rules.apply_rules(spark, docs, labels).count() == docs.count()
    assert quality_rules.apply_rules(spark, empty, labels).count() == 0


# Toxicity -----------------------------------------------------------------------------------


def test_toxicity_is_learned_on_the_training_rows_only(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 6 == 0
        w = words(rng, 60).split()
        if toxic:
            for k in range(3):
                w.insert(rng.randrange(60), "vequ" + rng.choice(["on", "er", "an", "il"]) if i % 12 else "idiot")
        rows.append((i, " ".join(w), None, None, 0, 0, 0.0, ""))
        labels.append((i, int(toxic)))
    docs, truth = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(spark, docs, truth)
    held = {r["doc_id"]: (r["h"], r["toxicity_score"]) for r in toxicity.score(docs, model).select("doc_id", "toxicity_score", toxicity.held_out_column().alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, (h, _) in held.items())
    own = [(held[i][1] >= 0.7, bool(y)) for i, y in labels if held[i][0]]
    assert sum(a and b for a, b in own) >= 0.9 * sum(b for _, b in own) and not any(a and not b for a, b in own)
    # Labels of held-out rows change nothing.
    flipped = truth.withColumn("toxic", F.when(toxicity.held_out_column(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(spark, docs, flipped)
    assert again.bias == model.bias and again.once == model.once and again.twice == model.twice


def test_label_model_weighs_voters_by_accuracy():
    rng = np.random.default_rng(0)
    y = rng.random(2000) < 0.2
    good = np.where(rng.random(2000) < 0.9, y, ~y) * 2 - 1
    noise = rng.integers(0, 2, 2000) * 2 - 1
    q, table, correlation = toxicity.label_model(np.stack([good, good, noise], axis=1), y.astype(int), 0.2)
    assert table[1, 0, 2] > 0.8 and abs(table[1, 2, 2] - table[0, 2, 2]) < 0.1 and correlation[0, 1] > 0.2 > correlation[0, 2]
    assert ((q > 0.5) == y).mean() > 0.85


def test_toxicity_of_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(spark, docs, none)
    out = toxicity.score(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r["toxicity_score"] <= 1 and r["score"] == 0.5 for r in out)
    score = model.scorer()
    assert score("You IDIOT moron") > 0.7 > score(None) == score("")
    assert toxicity.score(empty, model).count() == 0


# Decontamination ------------------------------------------------------------------------------


BENCH = [
    (0, "If Alice buys 3 apples for 12 dollars, how many apples does Alice get for 20 dollars in the shop?"), (1, "the of"), (2, None), (3, ""),
    (4, "Then the old river ran over wide green hills and into a quiet valley where nobody had lived."), (4, "Then the old river ran over wide green hills and into a quiet valley where nobody had lived."),
]


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in BENCH], "item_id long, text string, doc_id int")


def test_leaks_are_found_and_clean_texts_left(spark, benchmark):
    rng = random.Random(4)
    pad = words(rng, 200)
    rows = [
        (1, f"{pad} {BENCH[0][1]} {pad}"), (2, pad), (3, None), (4, ""),
        (5, f"{pad}. Now if Robert buys 5 apples for 17 dollars, how many apples does Robert get for 90 dollars in the shop? {pad}"),
        (6, f"{pad}. Now if Robert buys 5 apples for 17 dollars, how many pears does Zed find under 90 old trees near a mill? {pad}"),
        (7, "THEN the old  river ran\nover wide green hills, and into a quiet valley where nobody had lived"), (None, BENCH[4][1]), (8, "If Alice buys 3 apples"),
        (9, "12 13 14 15 16 17 18 19 20 21 22 23"),
    ]
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, item_id int")
    got = Counter((r["id"], r["item_id"], r["kind"]) for r in decontaminate.contaminated(spark, df, benchmark).collect())
    assert got == Counter({(1, 0, "exact"): 1, (5, 0, "reparameterised"): 1, (7, 4, "exact"): 2, (None, 4, "exact"): 2})


def test_inconsistent_slots_do_not_match(spark):
    """Equal values of the item must stand for equal values of the document."""
    item = spark.createDataFrame([(0, "there are 5 red and 5 blue and 5 green balls here")], "item_id long, text string")
    df = spark.createDataFrame([(1, "there are 7 red and 7 blue and 7 green balls here"), (2, "there are 7 red and 8 blue and 9 green balls here")], "doc_id long, text string")
    assert [(r["id"], r["kind"]) for r in decontaminate.contaminated(spark, df, item).collect()] == [(1, "reparameterised")]


def test_windows_are_those_of_brute_force(spark, docs, texts, benchmark):
    """Every whole benchmark-free text taken as an item finds itself, and no unrelated pair is reported."""
    items = spark.createDataFrame([(i, t) for i, t in texts if i and i >= 100], "item_id long, text string")
    got = {(r["id"], r["item_id"]) for r in decontaminate.contaminated(spark, docs, items).collect()}
    long_enough = {i for i, t in texts if i and i >= 100 and len(t.split()) >= 5}
    assert {(i, i) for i in long_enough} <= got
    sets = {i: _grams(t) for i, t in texts if i}
    for d, i in got:
        assert sets[d] & sets[i]


def _grams(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}


def test_decontamination_of_nothing(spark, docs, empty, benchmark):
    assert decontaminate.contaminated(spark, empty, benchmark).count() == 0
    assert decontaminate.contaminated(spark, docs, benchmark.limit(0)).count() == 0


# Sharding -------------------------------------------------------------------------------------


def test_curve_visits_neighbours():
    for dims, bits in ((2, 3), (3, 4)):
        order = sharding.curve(dims, bits)
        assert sorted(order) == list(range(1 << dims * bits))
        side, place = 1 << bits, {v: c for c, v in enumerate(order)}
        points = [[place[k] >> bits * (dims - 1 - d) & side - 1 for d in range(dims)] for k in range(len(order))]
        assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(points, points[1:]))


def test_shards_are_even_and_gapless(spark, docs, texts):
    out = sharding.shard(spark, docs, shards=7).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r["id"], r["size"], r["text_crc32"]) for r in out) == want
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(slots) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1
    ends = [(min(r["curve_index"] for r in out if r["shard"] == s), max(r["curve_index"] for r in out if r["shard"] == s)) for s in range(7)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_sharding_few_and_no_rows(spark, docs, empty):
    assert sharding.shard(spark, empty).count() == 0
    few = sharding.shard(spark, docs.limit(5)).collect()
    assert len({r["shard"] for r in few}) == 5 and all(r["slot"] == 0 for r in few)
