import hashlib
import random
import re

import pytest

from recweld.llm import decontaminate as D
from recweld.llm.decontaminate import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        words = WORD.findall(lower(text))
        hit, found = set(), []
        for item_id, item in items:
            own = WORD.findall(lower(item))
            n = min(10, len(own))
            spans = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
            at = [i for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in spans] if n else []
            if at:
                found.append(item_id)
                hit |= {j for i in at for j in range(i, i + n)}
        ids = ",".join(sorted(str(x) for x in found))
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "gamma", "délta", "x1", "über", "zz"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 4, 9, 10, 11, 25]))) for i in range(30)] + [(90, None), (91, ""), (92, "--!"), (7, "one two three")]
    docs = [(i, say(rng.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, "Alpha"), (102, "Alpha"), (None, "one, TWO-three four")]
    docs += [(200 + i, f"pre {say(5)} {items[i][1]}! {say(3)}") for i in range(30)]
    return docs, items


@pytest.mark.parametrize("block", [1 << 25, 200])
def test_equals_brute_force(spark, block):
    docs, items = cases()
    got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("x", "y").selectExpr("*", "1 as item_id", "'a' as lang").repartition(3), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, items).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r)[:4] for r in decontaminate(some, items).collect()] == [(1, 2, 0, 0)]


def test_copies_of_an_item_fill_no_block(spark):
    items = spark.createDataFrame([(1, "the same item again and again")] * 400 + [(2, "x " * 3000)], "item_id long, text string").selectExpr("cast(item_id as string) as item", "text")
    blocks = D._item_blocks(items, 2000)
    sizes = [[len(r["text"]) for r in b.collect()] for b in blocks]
    assert sum(map(len, sizes)) == 401 and all(sum(x) <= 2000 or len(x) == 1 or max(x) > 2000 for x in sizes) and len(sizes) > 6
    docs = spark.createDataFrame([(1, "say the same item again and again"), (2, None), (3, "other words")], "doc_id long, text string")
    bench = items.selectExpr("cast(item as long) as item_id", "text")
    assert sorted((r[0], r[2], r[3]) for r in D.decontaminate(docs, bench, block_bytes=2000).collect()) == [(1, 6, 400), (2, 0, 0), (3, 0, 0)]
    assert sorted(r[0] for r in D.drop_contaminated(docs, bench, block_bytes=2000).collect()) == [2, 3]
