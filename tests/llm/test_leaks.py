"""Leaks that templates alone cannot tell: copies with one typo, short and number-heavy items."""

from traceloom.llm import decontaminate

PASSAGE = (
    "then Tom went down to the old river and looked for the boat that his father had left there while the wide green hills lay still, "
    "and later Tom found it under some leaves near the mill where nobody had lived for a long while and slept beside it until the morning came, so that Tom was late again"
)


def reported(spark, items, texts):
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    return sorted((r["id"], r["item_id"], r["kind"]) for r in decontaminate.contaminated(spark, docs, items).collect())


def test_a_typo_in_one_slot_does_not_hide_a_copy(spark):
    typo = PASSAGE.replace("that Tom was", "that Tim was")
    assert reported(spark, [PASSAGE], [f"first words of a text {typo} and its last ones", "nothing of it"]) == [(0, 0, "exact")]


def test_short_and_number_heavy_items_match_exactly(spark):
    items = ["什么是世界上最高的山峰", "Who wrote Middlemarch exactly", "12 13 14 15 16 17 18 19 20 21 22 23", "the of"]
    texts = [f"答案如下。{items[0]}？是珠穆朗玛峰", f"some words. {items[1]}? and others", f"list {items[2]} end", "list 12 13 14 15 99 98 97 96 95 94 93 92 end", "one of the of two", "The of."]
    assert reported(spark, items, texts) == [(0, 0, "exact"), (1, 1, "exact"), (2, 2, "exact"), (5, 3, "exact")]


def test_names_of_any_number_of_words_are_one_slot(spark):
    item = "What is the capital of France and who founded it?"
    texts = [item.replace("France", x) for x in ("Spain", "New Zealand", "Trinidad and Tobago")] + [f"He asked: what is the capital of Papua New Guinea and who founded it? {PASSAGE}"]
    assert reported(spark, [item], texts) == [(0, 0, "reparameterised"), (1, 0, "reparameterised"), (3, 0, "reparameterised")]
    item = "Why did New York City win over Los Angeles Angels when New York City lost at home to old rivals?"
    texts = [item, item.replace("New York City", "Boston"), "Why did Boston win over Los Angeles Angels when Chicago lost at home to old rivals?", f"note that {item} so"]
    assert reported(spark, [item], texts) == [(0, 0, "exact"), (1, 0, "reparameterised"), (3, 0, "exact")]


def test_items_of_three_words_are_found_within_texts(spark):
    items = ["Who wrote Hamlet?", "two plus two equals", "a b c", "New South Wales Western Australia Old Town Road is", "Who wrote Hamlet?"]
    texts = [f"{PASSAGE}. Who wrote Hamlet? Shakespeare did", "we said that two plus two equals four", "then a b c came", "in New South Wales Western Australia Old Town Road is played", "a b c", "who Wrote nothing"]
    assert reported(spark, items, texts) == [(0, 0, "exact"), (0, 4, "exact"), (1, 1, "exact"), (3, 3, "exact"), (4, 2, "exact")]


def brute(item, text, width=8):
    """Whether a run of the item's tokens that covers half of it, in windows, lies in the text with all its values."""
    split = lambda t: [x.lower() for x in decontaminate.TOKEN.findall(t) if x[0].isalnum()]
    a, b = split(item), split(text)
    w = min(width, len(a))
    there = {tuple(b[k : k + w]) for k in range(len(b) - w + 1)}
    covered = {j for k in range(len(a) - w + 1) if w and tuple(a[k : k + w]) in there for j in range(k, k + w)}
    return bool(a) and (2 * len(covered) >= len(a) or len(covered) >= 25)


def test_copies_are_those_of_all_pairs(spark):
    """On the smallest tables: each pair whose windows agree by brute force is reported, and no other is exact."""
    from conftest import SMALL

    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts += [" ".join(t.split()[k:]) for t in items for k in (3, 12)]
    want = {(d, i) for i, item in enumerate(items) for d, t in enumerate(texts) if brute(item, t)}
    got = reported(spark, items, texts)
    assert len(want) > 20 and {(d, i) for d, i, kind in got if kind == "exact"} == want
