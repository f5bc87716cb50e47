import random

import duckdb
import pytest
from harness import SF

from weirflow.llm import chunking, queries, tokens


def texts():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()


def check(text, limit=512, overlap=64):
    coder = tokens.encoding()
    pieces = chunking.cut_text(text, limit, overlap)
    assert "".join(text[own:z] for _, own, z, _ in pieces) == text
    for k, (a, own, z, n) in enumerate(pieces):
        assert n == len(coder.encode_ordinary(text[a:z])) <= limit
        assert len(pieces) == 1 or own < z
        if k:
            assert pieces[k - 1][0] <= a <= own == pieces[k - 1][2]
            assert len(coder.encode_ordinary(text[a:own])) >= min(overlap, pieces[k - 1][3]) - 3
    return pieces


def test_whole_texts():
    cut = [check(t) for _, t in texts()]
    kinds = [max(chunking.boundaries(chunking.np.frombuffer(t.encode("utf-32-le"), chunking.np.uint32))[z] for z in [p[2] for p in pieces[:-1]]) for pieces, (_, t) in zip(cut, texts()) if len(pieces) > 1]
    assert sum(k >= chunking.SENTENCE for k in kinds) > 0.9 * len(kinds)


@pytest.mark.parametrize("text", ["", " ", "a", "x" * 40_000, "\n" * 5_000, "日本語。" * 3_000, "�" * 4_000, "👩‍👩‍👧" * 1_500, "a' b's " * 3_000, "0123456789abcdef" * 2_000 + " end", "word " * 60_000])
def test_odd_texts(text):
    check(text)
    check(text, 40, 8)
    check(text, 40, 0)


def test_an_edit_alters_only_neighbours():
    rng = random.Random(3)
    words = [f"w{rng.randrange(3_000)}" for _ in range(20_000)]
    text = "".join(w + (".\n\n" if rng.random() < 0.01 else ". " if rng.random() < 0.06 else " ") for w in words)
    old = {text[own:z] for _, own, z, _ in chunking.cut_text(text)}
    at = text.index(" ", 3_000)
    edited = text[:at] + " some new words here" + text[at:]
    new = [edited[own:z] for _, own, z, _ in chunking.cut_text(edited)]
    assert sum(p not in old for p in new) <= 6 < len(new) / 10


def test_table_and_edges(spark):
    rows = queries.p10_pieces(spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in texts():
        pieces = sorted(by[i], key=lambda r: r.piece_no)
        assert "".join(p.piece_text[p.own_start - p.char_start :] for p in pieces) == t
        assert all(p.n_tokens <= 512 for p in pieces)
    df = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (2, "", "z"), (None, "hello", "z")], "id long, text string, piece_text string")
    assert sorted(((r.doc_id or 0), r.n_tokens, r.piece_text) for r in chunking.cut_texts(df, "id", "text").collect() if r.piece_text is not None) == [(0, 1, "hello"), (2, 0, ""), (2, 0, "")]
    assert chunking.cut_texts(df, "id", "text").where("piece_text is null").count() == 1
    assert chunking.cut_texts(df.limit(0), "id", "text").count() == 0
    with pytest.raises(ValueError):
        chunking.cut_texts(df, "id", "text", 64, 32)


def test_pieces_are_filled():
    sizes = [n for _, t in texts() for _, _, _, n in chunking.cut_text(t)[:-1]]
    assert sum(sizes) / len(sizes) > 0.75 * chunking.LIMIT
