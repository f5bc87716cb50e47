import itertools

import numpy as np
from harness import SF

from weirflow.llm import packing, queries, tokens


def test_each_step_is_the_smallest_sum():
    rng = np.random.default_rng(1)
    for capacity in (7, 12):
        for _ in range(20):
            sizes = rng.integers(1, capacity + 1, 30)
            packer = packing.SumOfSquares(capacity)
            fill, step_sums = {}, []
            for k, s in enumerate(sizes.tolist()):
                before = dict(fill)
                box = packer.place(s)
                fill[box] = fill.get(box, 0) + s
                assert fill[box] <= capacity
                options = []
                for b in [*before, None]:
                    trial = dict(before)
                    b = len(trial) if b is None else b
                    trial[b] = trial.get(b, 0) + s
                    if trial[b] <= capacity:
                        options.append(sum(n * n for n in np.bincount([capacity - f for f in trial.values()], minlength=capacity + 1)[1:capacity]))
                have = sum(n * n for n in np.bincount([capacity - f for f in fill.values()], minlength=capacity + 1)[1:capacity])
                assert have == min(options)
                step_sums.append(have)


def test_whole_table(spark):
    rows = queries.p8_containers(spark, SF).collect()
    sizes = {r.doc_id: r.n_tokens for r in tokens.token_counts(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text").collect()}
    held, pieces = {}, {}
    for r in rows:
        held[r.container_id] = held.get(r.container_id, 0) + r.n_tokens
        pieces.setdefault(r.doc_id, []).append((r.piece_no, r.first_token, r.n_tokens))
    assert set(pieces) == set(sizes) and max(held.values()) <= 2048
    for i, parts in pieces.items():
        parts.sort()
        assert [p[1] for p in parts] == list(itertools.accumulate([0, *[p[2] for p in parts[:-1]]]))
        assert sum(p[2] for p in parts) == sizes[i]
        assert len(parts) == max(1, -(-sizes[i] // 2048))
    assert sum(held.values()) / (2048 * len(held)) > 0.97


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert packing.pack(empty).count() == 0
    rows = packing.pack(spark.createDataFrame([(1, None), (2, 0), (3, 10), (3, 10), (4, 25), (None, 4)], "doc_id long, n_tokens long"), capacity=10).collect()
    assert sorted(((r.doc_id or 0), r.piece_no, r.n_tokens) for r in rows) == [(0, 0, 4), (1, 0, 0), (2, 0, 0), (3, 0, 10), (3, 0, 10), (4, 0, 10), (4, 1, 10), (4, 2, 5)]
    clash = spark.createDataFrame([(1, "a b", 7, "x")], "id long, body string, n_tokens long, text string")
    assert [tuple(r) for r in tokens.token_counts(clash, "id", "body").collect()] == [(1, 2)]
    none = spark.createDataFrame([(1, None), (2, "")], "id long, body string")
    assert [r.n_tokens for r in tokens.token_counts(none, "id", "body").collect()] == [0, 0]


def test_many_groups_in_a_task(spark):
    rng = np.random.default_rng(5)
    data = [(i, int(n)) for i, n in enumerate(rng.integers(0, 30, 3_000))]
    df = spark.createDataFrame(data, "doc_id long, n_tokens long").repartition(3)
    rows = packing.pack(df, capacity=20, group_tokens=200).collect()
    held = {}
    for r in rows:
        held[r.container_id] = held.get(r.container_id, 0) + r.n_tokens
    assert max(held.values()) <= 20 and len({c >> 40 for c in held}) > 100
    by = {}
    for r in rows:
        by[r.doc_id] = by.get(r.doc_id, 0) + r.n_tokens
    assert by == dict(data)
    # far fewer tasks than groups
    assert packing.pack(df, capacity=20, group_tokens=200).rdd.getNumPartitions() <= 8


def test_a_shipped_vocabulary(spark, tmp_path):
    import shutil

    named = str(tmp_path / "here.tiktoken")
    shutil.copy(tokens.RANKS, named)
    assert tokens.ship(spark, named) == named
    # a path that isn't there, as on an executor that has only what was shipped
    named = str(tmp_path / "elsewhere" / "here.tiktoken")
    df = spark.createDataFrame([(1, "two words")], "id long, body string")
    assert [r.n_tokens for r in tokens.token_counts(df, "id", "body", named).collect()] == [2]
