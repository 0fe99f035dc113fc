"""Toxicity by weak supervision.

Many voters (word lists, patterns, and word stems found in labelled rows) say
toxic, clean or nothing about a text. A generative label model estimates each
voter's accuracy by expectation maximisation and the correlations that are left
between voters once the label is known, counts correlated voters for less, and
gives each training text a posterior label. A linear classifier on word and stem
features, trained on the posteriors, scores every text (Ratner et al., "Data
programming", NeurIPS 2016).

Fitting reads at most MAX_LABELLED labelled rows, chosen by a hash of their id and
text; scoring reads every whole text. The features of the rows fitted are counted
on the executors; the driver gets the counts of the best of them and, of a row, a
bit for each column of the classifier.

What is known of the word lists before any label is part of every fit, as PRIOR
rows made of them: with few labels they decide, with many they count for little.

Defined results: a null or empty text gets the score of a text without any
feature; rows that repeat get a score each; a null id is scored as any other and
its row counts as not held out; an empty table gives no row.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm.shared import cut, map_arrow

#: Labelled rows that fitting reads at most.
MAX_LABELLED = 8000
#: Columns of the linear classifier at most.
MAX_FEATURES = 512
#: Rows of each word list, and clean ones, that every fit begins with; not of lists whose words are other languages' plain words ("die").
PRIOR, PRIOR_CLEAN, AMBIGUOUS = 12, 240, ("hate",)
#: Lengths of the stems of a word that are features.
STEMS = (4, 5, 6, 7, 8)
SPACE = 1 << 20
WORD = re.compile(r"[^\W\d_]+")

#: Word lists of the voters (fixed values).
LEXICONS = {
    "wits": "idiot idiots moron morons stupid dumb imbecile fool fools dimwit halfwit",
    "worth": "worthless loser losers pathetic useless failure nobody",
    "filth": "trash garbage scum filth filthy vermin disgusting rubbish",
    "scorn": "clown clowns joke freak freaks creep jerk hypocrite",
    "hate": "hate despise loathe die kill ugly liar",
}
SECOND_PERSON = re.compile(r"\b(?:you|your|tu|du|ihr|vous|eres)\b")


def token_features(token: str) -> tuple[int, ...]:
    """Hashed features of a word: itself and its stems."""
    raw = [zlib.crc32(b"=" + token.encode()) % SPACE]
    raw += [zlib.crc32(token[:k].encode() + b"*") % SPACE for k in STEMS if len(token) > k]
    return tuple(raw)


@dataclass
class Model:
    """A fitted classifier: weights by (feature, at least how often), and the lexicon columns."""

    bias: float
    once: dict[int, float] = field(default_factory=dict)
    twice: dict[int, float] = field(default_factory=dict)
    lists: list[tuple[frozenset, float, float]] = field(default_factory=list)

    def scorer(self):
        """A function from text to score that remembers which words have a feature."""
        known: dict[str, tuple[int, ...]] = {}
        once, twice = self.once, self.twice
        wanted = once.keys() | twice.keys()
        any_list = frozenset().union(*(words for words, _, _ in self.lists)) if self.lists else frozenset()

        def score(text: str | None) -> float:
            counts = Counter(WORD.findall((text or "").lower()))
            z, found = self.bias, Counter()
            if len(known) > 100_000:
                known.clear()
            for token, n in counts.items():
                hits = known.get(token)
                if hits is None:
                    hits = known[token] = tuple(f for f in token_features(token) if f in wanted)
                for f in hits:
                    found[f] += n
            for f, n in found.items():
                z += once.get(f, 0.0) + (twice.get(f, 0.0) if n > 1 else 0.0)
            present = any_list.intersection(counts)
            if present:
                for words, one, two in self.lists:
                    n = sum(counts[w] for w in present if w in words)
                    z += (one if n else 0.0) + (two if n > 1 else 0.0)
            return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))

        return score


def held_out_column(id_col: str = "doc_id"):
    """True where crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def label_model(votes: np.ndarray, seen: np.ndarray, prior: float, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of label 1 for each row, each voter's table P(vote | label), and voter correlations.

    votes: rows x voters of -1 (clean), 0 (nothing), 1 (toxic). seen: labels that
    start the tables. Correlated voters share one voice: a voter's evidence is
    divided by one plus its correlations, given the label, with the others.
    """
    n, m = votes.shape
    q = np.where(seen > 0, 0.9, 0.02).astype(float)
    levels = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    correlation, share = np.zeros((m, m)), np.ones(m)
    table = np.full((2, m, 3), 1 / 3)
    for step in range(rounds):
        for y, w in ((0, 1 - q), (1, q)):
            counts = np.einsum("i,ijv->jv", w, levels) + 0.5
            table[y] = counts / counts.sum(axis=1, keepdims=True)
        if step % 5 == 4 and m > 1:
            expected = np.stack([table[y] @ np.array([-1.0, 0.0, 1.0]) for y in (0, 1)])
            rest = votes - ((1 - q)[:, None] * expected[0] + q[:, None] * expected[1])
            scale = np.sqrt((rest**2).mean(axis=0)) + 1e-3
            correlation = np.abs((rest.T @ rest) / max(n, 1) / np.outer(scale, scale))
            np.fill_diagonal(correlation, 0.0)
            correlation[correlation < 0.1] = 0.0
            share = 1 / (1 + correlation.sum(axis=1))
        evidence = np.einsum("ijv,jv->ij", levels, np.log(table[1] / table[0])) @ share
        new = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + evidence, -30, 30)))
        # A label that was seen stays as one more voter of high accuracy.
        odds = new / (1 - new + 1e-12) * np.where(seen > 0, 9.0, 1 / 9.0)
        if np.abs(odds / (1 + odds) - q).max() < 1e-6:
            q = odds / (1 + odds)
            break
        q = odds / (1 + odds)
    return q, table, correlation


def logistic(x: np.ndarray, q: np.ndarray, penalty: float = 0.3, rounds: int = 30) -> tuple[float, np.ndarray]:
    """Bias and weights of an L2-penalised logistic regression on soft labels, by Newton steps."""
    n, k = x.shape
    a = np.hstack([np.ones((n, 1), dtype=x.dtype), x])
    w = np.zeros(k + 1)
    ridge = np.diag(np.r_[1e-3, np.full(k, penalty)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p) + 1e-6)[:, None].astype(a.dtype)).T @ a + ridge
        step = np.linalg.solve(h, a.T @ (q - p) - ridge @ w)
        w += step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    return float(w[0]), w[1:]


def _lexical(text: str, counts: Counter, lists: list[frozenset]) -> list[int]:
    """How often words of each list occur, up to 2, and whether the text addresses someone, is loud, or exclaims."""
    letters = sum(counts.values())
    loud = sum(map(str.isupper, text)) > 0.6 * max(1, sum(len(w) * n for w, n in counts.items()))
    marks = text.count("!") > 0.2 * max(1, letters)
    return [min(2, sum(counts[w] for w in words if w in counts)) for words in lists] + [int(bool(SECOND_PERSON.search(text.lower()))), int(loud), int(marks)]


def _features(counts: Counter) -> Counter:
    seen: Counter = Counter()
    for token, n in counts.items():
        for f in token_features(token):
            seen[f] += n
    return seen


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on labelled rows that are not held out; see the module's text."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out_column())
    sample = (
        usable.groupBy("doc_id")
        .agg(F.avg("toxic").alias("share"))
        .select(F.col("doc_id").alias("id"), (F.col("share") >= 0.5).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_labelled)
    )
    # At most max_labelled rows of two numbers: a proven bound.
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "id")
    # Where ids repeat, the bound holds for rows.
    rows = cut(spark, rows.withColumn("hash", F.xxhash64("id", "text")), "labelled")
    least = rows.select("hash").orderBy("hash").limit(max_labelled).agg(F.max("hash")).first()[0]
    rows = rows.where(F.col("hash") <= F.lit(0 if least is None else least)).select("toxic", "text")
    names = sorted(LEXICONS)
    columns = _chosen_features(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [frozenset(LEXICONS[k].split()) for k in names]
        for batch in batches:
            found, lex = [], []
            for text in (t or "" for t in batch.column(1).to_pylist()):
                counts = Counter(WORD.findall(text.lower()))
                seen = _features(counts)
                found.append(np.packbits(np.array([seen.get(f, 0) >= level for level, f in columns], dtype=bool)).tobytes())
                lex.append(_lexical(text, counts, lists))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), pa.array(lex, pa.list_(pa.int32()))], names=["toxic", "found", "lex"])

    # In an order that the rows' contents decide, so that the fit does not depend on their files.
    found = sorted((r["toxic"], bytes(r["found"]), tuple(r["lex"])) for r in map_arrow(rows, run, "toxic int, found binary, lex array<int>").collect())
    width = -(-len(columns) // 8)
    bits = np.unpackbits(np.frombuffer(b"".join(f for _, f, _ in found), np.uint8).reshape(len(found), width), axis=1)[:, : len(columns)]
    y = np.array([t for t, _, _ in found], dtype=int)
    lex = np.array([x for _, _, x in found], dtype=int).reshape(len(found), len(names) + 3)
    # The prior rows: PRIOR with two words of each sure list, and PRIOR_CLEAN with none.
    sure = [k for k, name in enumerate(names) if name not in AMBIGUOUS]
    known = np.zeros((PRIOR * len(sure) + PRIOR_CLEAN, lex.shape[1]), dtype=int)
    for at, k in enumerate(sure):
        known[PRIOR * at : PRIOR * (at + 1), k] = 2
    lex = np.vstack([known, lex])
    y = np.r_[known.any(axis=1).astype(int), y]
    bits = np.vstack([np.zeros((len(known), len(columns)), dtype=np.uint8), bits])
    return _fit_arrays(y, columns, bits.astype(np.float32), lex, names)


def _chosen_features(rows: DataFrame) -> list[tuple[int, int]]:
    """(level, feature) of the classifier's columns.

    Each task counts its rows' features once; the counts are summed and judged on the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Texts by feature and label: at any count, and at two or more.
        counts, n = np.zeros((2, 2, SPACE), dtype=np.int32), [0, 0]
        for batch in batches:
            for y, text in zip(*(c.to_pylist() for c in batch.columns)):
                n[y] += 1
                seen = _features(Counter(WORD.findall((text or "").lower())))
                counts[0, y, list(seen)] += 1
                counts[1, y, [f for f, k in seen.items() if k > 1]] += 1
        for level in (0, 1):
            at = np.flatnonzero(counts[level].any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), level + 1, np.int32)), pa.array(at), pa.array(counts[level, 1, at], pa.int64()), pa.array(counts[level, 0, at], pa.int64())], names=["level", "feature", "a", "b"])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0]), pa.array([n[1]], pa.int64()), pa.array([n[0]], pa.int64())], names=["level", "feature", "a", "b"])

    partial = map_arrow(rows, run, "level int, feature bigint, a bigint, b bigint")
    sums = cut(rows.sparkSession, partial.groupBy("level", "feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "feature-counts")
    size = sums.where("level = 0").select("a", "b").first()
    na, nb = (size["a"], size["b"]) if size else (0, 0)
    if not na or not nb:
        return []
    tests = sums.where("level > 0").count()
    a, b, total = F.col("a"), F.col("b"), float(na + nb)
    share = lambda x, of: F.when(x > 0, x * F.log(x / ((a + b) * (of / total)))).otherwise(0.0)
    # The G statistic, of features that toxic texts have more often; a voter must be right more often than not, beside being no accident.
    found = sums.where("level > 0").withColumn("g", 2 * (share(a, na) + share(b, nb)))
    top = found.where((F.col("g") > float(2 * np.log(max(tests, 2)) + 4)) & (a / na > 3 * b / nb))
    best = top.orderBy(F.desc("g"), "level", "feature").limit(MAX_FEATURES).collect()
    return [(r["level"], r["feature"]) for r in best]


def _fit_arrays(y: np.ndarray, columns: list[tuple[int, int]], found: np.ndarray, lex: np.ndarray, names: list[str]) -> Model:
    na = int(y.sum())
    # Voters: each word list, the patterns, and the found stems in groups.
    k = len(names)
    voters = [np.where(lex[:, j] > 0, 1, 0) for j in range(k)]
    voters += [np.where(lex[:, : k].sum(axis=1) > 1, 1, -1)]
    voters += [np.where((lex[:, k] > 0) & (lex[:, :k].sum(axis=1) > 0), 1, 0)]
    voters += [np.where(lex[:, k + 1] > 0, 1, 0), np.where(lex[:, k + 2] > 0, 1, 0)]
    groups = 12
    for g in range(min(groups, len(columns))):
        own = [c for c in range(len(columns)) if c % groups == g]
        voters.append(np.where(found[:, own].any(axis=1), 1, 0))
    if columns:
        voters.append(np.where(found.any(axis=1) | (lex[:, :k].sum(axis=1) > 0), 0, -1))
    votes = np.stack(voters, axis=1).astype(np.int8)
    q, _, _ = label_model(votes, y, min(0.5, max(0.005, na / max(len(y), 1))))
    x = np.hstack([found, lex[:, :k] > 0, lex[:, :k] > 1]).astype(np.float32)
    bias, w = logistic(x, q)
    model = Model(bias)
    for (level, f), weight in zip(columns, w):
        (model.once if level == 1 else model.twice)[f] = float(weight)
    c = len(columns)
    model.lists = [(frozenset(LEXICONS[names[j]].split()), float(w[c + j]), float(w[c + k + j])) for j in range(k)]
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a column score, from 0 to 1; every whole text is read."""
    name = "score" if "score" not in docs.columns else "toxicity_score"
    schema = docs.select("*", F.lit(0.0).alias(name)).schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            values = [of(None if t is None else str(t)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=schema.names)

    return map_arrow(docs, run, schema)
