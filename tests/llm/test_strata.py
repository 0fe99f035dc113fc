"""Quality cutoffs over many strata, and the verdict by brute force."""

import math
import random

from traceloom.llm import quality_rules as Q


def test_a_hundred_strata_with_all_rules_judge(spark):
    strata = tuple(f"s{k:03d}" for k in range(100))
    rows = [(k, s, 100, 600, 5 * (k % 7), 0, 0, 0, 0, 1, 0, 90) for k, s in enumerate(strata * 3 + ("other", None))]
    schema = "id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_marks long, n_upper long, n_lines long, n_unended long, n_kinds long"
    bins = {(s, rule): 10 + i for i, s in enumerate(strata) for rule in Q.RULES} | {("", "symbols"): 60}
    out = Q.judge(spark.createDataFrame(rows, schema), Q.Cutoffs(strata, bins, {})).collect()
    assert len(out) == len(rows)
    for r in out:
        cutoff = bins[r["lang"], "symbols"] if r["lang"] in strata else 60
        rejecting = {"symbols"} if math.floor(r["n_symbols"] / 100 * Q.BINS) >= cutoff else set()
        for rule, value in (("long_words", 6 / 40), ("few_kinds", 0.0), ("marks", 0.0), ("capitals", 0.0)):
            if r["lang"] in strata and math.floor(value * Q.BINS) >= bins[r["lang"], rule]:
                rejecting.add(rule)
        assert r["kept"] == (not rejecting) and (r["rule"] in rejecting if rejecting else r["rule"] is None)


def brute_bound(failures, n, error):
    lo, hi = 0.0, 1.0
    for _ in range(80):
        p = (lo + hi) / 2
        tail = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(failures + 1))
        lo, hi = (p, hi) if tail > error else (lo, p)
    return 1.0 if failures >= n else hi


def brute_kept(measured, good, least, risk=0.05, error=0.05, shares=(0.0, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05)):
    """The verdict of every row: rows of (id, lang, half, {rule: bin}, base_failed)."""
    held = [m for m in measured if m[0] in good and not m[4]]
    per = {}
    for _, s, *_ in (m for m in held if good[m[0]]):
        per[s] = per.get(s, 0) + 1
    own = {s for s, n in per.items() if n >= least and s}
    place = lambda s: s if s in own else ""
    strata = sorted({place(m[1]) for m in held if m[2]})
    chosen = {}
    for s in strata:
        first, second = ([m for m in held if place(m[1]) == s and m[2] is half] for half in (True, False))
        policies = []
        for share in shares:
            policy = {}
            for rule in Q.RULES:
                g, b = ([m[3][rule] for m in first if good[m[0]] is y] for y in (True, False))
                counts = [[x.count(k) for k in range(Q.BINS)] for x in (g, b)]
                if (c := Q.propose(*counts, share)) is not None:
                    policy[rule] = c
            policies.append(policy)
        best, passed = 0, []
        for policy in policies:
            passed.append(policy)
            hit = [any(m[3][r] >= c for p in passed for r, c in p.items()) for m in second]
            lost, won = (sum(h for h, m in zip(hit, second) if good[m[0]] is y) for y in (True, False))
            n = sum(good[m[0]] for m in second)
            if not n or brute_bound(lost, n, error / len(strata)) > risk:
                break
            if won - lost > best:
                best, chosen[s] = won - lost, policy
    return {m[0]: not m[4] and not any(m[3][r] >= c for r, c in chosen.get(place(m[1]), {}).items()) for m in measured}


def test_verdicts_are_brute_force(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(2400):
        lang, junk = rng.choice(["en", "en", "de", "fr", "xx", None]), rng.random()
        # Junk has more symbols than most good texts, but not than all of them.
        good = rng.random() < 0.7
        marks = rng.randint(0, 12) if good else rng.randint(9, 60)
        words = [("w" + str(rng.randint(0, 400))) for _ in range(rng.choice([30, 80, 120]))]
        for _ in range(marks if junk < 0.9 else 0):
            words.insert(rng.randrange(len(words)), "##")
        rows.append((i, " ".join(words) + rng.choice([".", ""]), lang))
        if rng.random() < 0.8:
            labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    truth = spark.createDataFrame(labels, "doc_id long, quality int")
    from pyspark.sql import functions as F

    held = Q.measure(docs, keep=("lang",)).select("id", "lang", (F.pmod(F.xxhash64("id"), F.lit(2)) == 0).alias("half"), Q._base_failed().alias("failed"), *(Q._bin(r).alias(r) for r in Q.RULES)).collect()
    measured = [(r["id"], r["lang"] or "", r["half"], {x: r[x] for x in Q.RULES}, r["failed"]) for r in held]
    want = brute_kept(measured, {i: bool(y) for i, y in labels}, 150)
    got = {r["id"]: r["kept"] for r in Q.apply_rules(spark, docs, truth).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)
    good = {i for i, y in labels if y}
    assert sum(1 for m in measured if m[0] in good and not m[4] and not want[m[0]]) <= 0.06 * sum(1 for m in measured if m[0] in good and not m[4])
