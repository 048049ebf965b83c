"""An open passage is linked with one holder of its like, not with every one, and copies are not compared."""

import random

from cellweave.llm import substring


def test_one_link_for_a_passage_that_many_hold(spark):
    rng = random.Random(21)
    text = lambda n: ["v%d" % rng.randrange(100_000) for _ in range(n)]
    base, head, tail = text(60), text(1), text(1)
    hold = lambda p: " ".join(text(50) + p + text(50))
    count = 60
    texts = [hold(base) for _ in range(count)] + [hold(base[:48] + tail + base[49:])]  # like the base, unlike the leader
    leaders = [hold(base[:11] + head + base[12:]) for _ in range(2000)]
    nodes = lambda rows: substring.keyed(spark.createDataFrame(rows, "doc_id long, text string")).select("node", "text").collect()
    first = min(nodes([(count + 1, x) for x in leaders]))
    assert first.node < min(nodes(list(enumerate(texts)))).node
    docs = list(enumerate([*texts, first.text])) + [(200, texts[0]), (201, texts[0])]
    rows = substring.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in rows} == {*range(count + 2), 200, 201}
    links = {(r.doc_id, r.class_id) for r in rows if r.doc_id != r.class_id and count in (r.doc_id, r.class_id)}
    assert 1 <= len(links) <= 3
    assert len(rows) <= 3 * len(docs)
