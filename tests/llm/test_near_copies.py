"""Near copies of the pipeline's third stage against all pairs by brute force."""

import random
from itertools import combinations

import pytest

from traceloom.llm import near_copies

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_groups(texts, similarity=0.8):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        either = len(sets[i] | sets[j])
        if not either or len(sets[i] & sets[j]) / either >= similarity:
            root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    out = [None, "", "one two", "ONE  two", "one two three"]
    for changes in (1, 2, 3, 4, 5, 6, 8, 12, 20):
        base = [word() for _ in range(200)]
        out.append(" ".join(base))
        for _ in range(6):
            near = list(base)
            for k in rng.sample(range(200), changes):
                near[k] = word()
            out.append(" ".join(near))
    return out


@pytest.mark.parametrize("small", [16, 2])
def test_groups_are_all_pairs(spark, texts, small):
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    got = {r["row"]: r["component"] for r in near_copies.groups(spark, df, small=small).collect()}
    assert got == dict(enumerate(brute_groups(texts)))


def test_stage_drops_all_near_copies(spark, texts):
    import corpus_pipeline as pipeline

    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], COLUMNS)
    got = {r["doc_id"] for r in pipeline.drop_near_copies(spark, docs, "").collect()}
    assert got == set(brute_groups(texts))


def test_stage_on_the_smallest_table(spark):
    import corpus_pipeline as pipeline
    from conftest import SMALL

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    want = {rows[k][0] for k in set(brute_groups([t for _, t in rows]))}
    assert {r["doc_id"] for r in pipeline.drop_near_copies(spark, docs, SMALL).collect()} == want


def test_stages_judge_rows_and_not_ids(spark):
    import corpus_pipeline as pipeline
    from conftest import SMALL

    leak = max((r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()), key=len)
    rng = random.Random(9)
    clean = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl"]) + str(rng.random())[2:] for _ in range(60)) for _ in range(2)]
    rows = [(None, leak), (1, leak), (1, clean[0]), (2, clean[1]), (None, clean[1])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS)
    got = pipeline.drop_contaminated(spark, docs, SMALL).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(str, [(1, clean[0]), (2, clean[1]), (None, clean[1])]))
    rows = [(1, clean[0]), (1, clean[1]), (None, clean[1]), (None, clean[1]), (None, leak), (2, clean[0])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS)
    got = pipeline.drop_near_copies(spark, docs, SMALL).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(str, [(1, clean[0]), (1, clean[1]), (None, clean[1]), (None, leak)]))


def test_a_large_group_is_not_compared_in_pairs(spark, monkeypatch):
    """Texts that all share most with one and too little with each other: only the few that are similar are held together."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    base, asked = [word() for _ in range(200)], []

    def changed(words, at):
        out = list(words)
        for k in at:
            out[k] = word()
        return out

    # Three words each: any two have a similarity of about 0.73. Every tenth has a closer one.
    far = [changed(base, (rng.randrange(5, 60), rng.randrange(70, 120), rng.randrange(130, 195))) for _ in range(150)]
    texts = [" ".join(w) for w in [*far, *(changed(w, [rng.randrange(5, 195)]) for w in far[::10])]]
    held = near_copies.with_texts
    monkeypatch.setattr(near_copies, "with_texts", lambda spark, pairs, rows: asked.append(pairs.count()) or held(spark, pairs, rows))
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    got = {r["row"]: r["component"] for r in near_copies.groups(spark, df).collect()}
    assert got == dict(enumerate(brute_groups(texts)))
    assert len(set(got.values())) <= 150
    assert sum(asked) < 10 * len(texts)
