"""Whole copies of every item, disturbed every few words, must be found."""

import duckdb
import pytest
from harness import SF

from weirflow.llm import leaks


def references(text):
    text = text.replace(", ", ",&nbsp;").replace(". ", ".&nbsp;")
    for w in ("and", "et", "und", "y"):
        text = text.replace(f" {w} ", f" &amp; {w} ")
    return text


def changed(every):
    return lambda text: " ".join(f"zq{7 * k}vx" if k % every == every - 1 else w for k, w in enumerate(text.split()))


@pytest.mark.parametrize("damage", [references, lambda t: references(t).replace("&", "&amp;"), lambda t: references(t).replace("&nbsp;", "nbsp ").replace("&amp;", "amp"), changed(7), changed(6)])
def test_damaged_copies(spark, damage):
    items = duckdb.sql(f"select item_id, item_text from '{SF}/benchmark_items.parquet'").fetchall()
    docs = spark.createDataFrame([(i, "Menu. Cookies. " + damage(t) + " Footer.") for i, t in items], "doc_id long, text string")
    found = leaks.find_leaks(docs, spark.createDataFrame(items, "item_id long, item_text string"))
    have = {(r.doc_id, r.item_id) for r in found.collect()}
    assert {(i, i) for i, _ in items} <= have


def test_texts_of_one_pattern():
    a = "Researchers in Axgalstow found that a wooden granary absorbs 856 grams more salt than a copper stable. In the novel by Umfollis, an ornate rudder follows Umothlofol across the pump for 357 nights."
    b = "Researchers in Mardasilbra found that a coastal valley absorbs 73 grams more salt than a modest station. In the novel by Umnia, a bitter garden follows Zinoth across the lever for 21 nights."
    item, starts = leaks.item_words(a)
    assert leaks.passages(item, starts, [(0, leaks.letters(b))])[0] < leaks.SHARE * (len(starts) - 1)
