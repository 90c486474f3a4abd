"""Every group of near-duplicates keeps one row, whatever its keys."""

from sievework.llm import simhash


def test_groups_without_a_key_or_with_a_shared_one_keep_a_row(spark):
    rows = [(None, "alone and clean one two three"), (None, "quite another text four five six"), (None, "same words in both of these"), (9, "same words in both of these"), (7, "first text under seven is here"), (7, "the second one differs from that"), (None, "twice without any key at all"), (None, "twice without any key at all")]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, fp int")
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    want = [rows[i] for i in (0, 1, 3, 4, 5, 6)]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)
