import collections
import random

import duckdb
from harness import SF

from weirflow.llm import leaks, queries


def brute(docs, items, share=leaks.SHARE):
    """Every document against every item: equal shingles by plain strings, no hashes, prefixes or bounds."""
    n = leaks.SHINGLE
    where, info = collections.defaultdict(set), {}
    for i, t in items:
        stream, starts = leaks.item_words(t)
        info[i] = (stream, starts)
        for p in range(len(stream) - n + 1):
            where[stream[p : p + n]].add(i)
    found = set()
    for d, t in docs:
        stream = leaks.letters(t)
        for i in {i for p in range(len(stream) - n + 1) for i in where.get(stream[p : p + n], ())}:
            item, starts = info[i]
            words, longest = leaks.passages(item, starts, [(0, stream)])
            if words >= share * (len(starts) - 1) and longest > leaks.QUOTE:
                found.add((d, i))
    return found


def test_same_as_brute_force(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, item_text from '{SF}/benchmark_items.parquet'").fetchall()
    want = brute(docs, items)
    assert {tuple(r) for r in queries.p9_found(spark, SF).collect()} == want and len(want) > 30
    per_item = {r.item_id: r.n_docs for r in queries.p9_items(spark, SF).collect()}
    assert per_item == collections.Counter(i for _, i in want)
    frames = (spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string"))
    blocks = leaks.find_leaks(*frames, block_shingles=20_000)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == want


def test_what_counts(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(60)
    w = item.split()
    changed = [word() if k % 9 == 4 else x for k, x in enumerate(w)]
    cases = {
        1: item,
        2: text(50) + "\n" + item.upper().replace(" ", ",\n") + text(50),
        3: "".join(w),
        4: " ".join(changed),
        5: " ".join(w[30:] + text(25).split() + w[:30]),
        6: " ".join(w[:33]),
        7: " ".join(w[:27]),
        8: " ".join(w[:12]) + text(80) + " ".join(w[40:52]),
        9: text(300),
        10: item.replace("a", "aé").replace("o ", "o� "),
        11: item,
        12: None,
        13: "",
        14: text(40_000) + " " + item,
        15: " ".join(w[:20]) + text(3_000) + " ".join(w[30:50]),
    }
    docs = spark.createDataFrame(list(cases.items()), "doc_id long, text string").selectExpr("doc_id", "text", "'x' item_id", "1 shingle")
    items = spark.createDataFrame([(7, item), (7, item), (8, None), (9, ""), (10, "too short"), (None, item)], "item_id long, item_text string")
    found = leaks.find_leaks(docs, items)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(i, 7) for i in (1, 2, 3, 4, 5, 6, 10, 11, 14, 15)]
    assert leaks.find_leaks(docs.limit(0), items).count() == 0
    assert leaks.find_leaks(docs, items.limit(0)).count() == 0
