"""Quotations inside quotations."""

from traceloom.llm import quotations


def test_a_top_posted_reply_is_the_parent(spark):
    rows = [
        ("c", 0, "a", "the first message"), ("c", 1, "b", "my reply to it\n\nOn Monday, A wrote:\n> the first message"),
        ("c", 2, "c", "and mine\n\nOn Tuesday, B wrote:\n> my reply to it\n>\n> On Monday, A wrote:\n>> the first message"),
    ]
    out = quotations.link(spark, spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()
    assert {r["turn"]: r["parent_turn"] for r in out} == {0: None, 1: 0, 2: 1}
