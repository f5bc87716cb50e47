"""Queries of the text problems, each over all documents with whole texts. p8_check and p10_joined put the results together again, which SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import chunking, leaks, packing, tokens
from weirflow.runtime import cut, table


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document's place in containers of 2,048 tokens."""
    return packing.pack(tokens.token_counts(table(spark, d, "documents"), "doc_id", "text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the test items they contain."""
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark_items")).select("doc_id", "item_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked test items: in how many documents, and the most words of it in one."""
    found = leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_words").alias("most_words"), F.max("of_words").alias("of_words"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All texts in pieces of at most 512 tokens, each repeating 64 of the one before."""
    return chunking.cut_texts(table(spark, d, "documents"), "doc_id", "text")


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """How many bytes the tokens in each document's pieces stand for, and how many of its pieces lie in containers over the capacity."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    placed = cut(p8_containers(spark, d))
    full = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("held"))
    pieces = placed.join(full, "container_id").groupBy("doc_id").agg(F.collect_list(F.struct("first_token", "n_tokens")).alias("pieces"), F.count(F.when(F.col("held") > packing.CAPACITY, 1)).alias("n_overfull"))
    counted = pieces.join(docs, "doc_id").mapInArrow(tokens.piece_bytes(), "doc_id long, n_bytes long, n_overfull long")
    return counted.select("doc_id", "n_bytes", "n_overfull")


def p10_joined(spark: SparkSession, d: str) -> DataFrame:
    """A digest of each document's pieces joined up again without their overlaps, and how many of them exceed the limit."""
    own = F.substring("piece_text", F.col("own_start") - F.col("char_start") + 1, F.length("piece_text"))
    part = F.struct("piece_no", own.alias("own"))
    # no more than one text for each document
    by = p10_pieces(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.count(F.when(F.col("n_tokens") > chunking.LIMIT, 1)).alias("n_over"))
    return by.select("doc_id", F.md5(F.concat_ws("", "parts.own")).alias("digest"), "n_over")


# the rule of p9_found in plain letters: equal stretches of 24, gaps of up to 24 letters between them filled
_LEAKS = r"""with docs as (select doc_id, regexp_replace(regexp_replace(lower(text), '&(amp;)?#?[a-z0-9]{2,8};', '', 'g'), '[^a-z0-9]', '', 'g') s from documents),
words as (select item_id, row_number() over (partition by item_id order by n) n, w from (
    select item_id, n, regexp_replace(lower(x[n]), '[^a-z0-9]', '', 'g') w from (select item_id, x, unnest(generate_series(1, len(x))) n from (select item_id, string_split_regex(item_text, '\s+') x from benchmark_items))) where w <> ''),
spans as (select item_id, n, sum(length(w)) over (partition by item_id order by n) - length(w) + 1 a, sum(length(w)) over (partition by item_id order by n) z from words),
items as (select item_id, string_agg(w, '' order by n) s, count(*) n_words from words group by 1),
own as (select item_id, p, s[p : p + 23] g from (select item_id, s, unnest(generate_series(1, length(s) - 23)) p from items)),
hits as (select doc_id, s[p : p + 23] g from (select doc_id, s, unnest(generate_series(1, length(s) - 23)) p from docs) where s[p : p + 23] in (select g from own)),
places as (select distinct doc_id, item_id, p from hits join own using (g)),
filled as (select doc_id, item_id, p a, greatest(p + 23, case when lead(p) over w - (p + 24) <= 24 then lead(p) over w - 1 end) z from places window w as (partition by doc_id, item_id order by p)),
letters as (select distinct doc_id, item_id, unnest(generate_series(a, z)) l from filled),
held as (select doc_id, item_id, n, count(*) k, any_value(spans.z - spans.a + 1) size from letters join spans using (item_id) where l between spans.a and spans.z group by 1, 2, 3)
select doc_id, item_id from held join items using (item_id) where 2 * k >= size group by doc_id, item_id, n_words having 2 * count(*) >= n_words"""

QUERIES = {f.__name__: f for f in (p8_containers, p8_check, p9_found, p9_items, p10_pieces, p10_joined)}
SQL = {
    "p8_check": "select doc_id, coalesce(strlen(text), 0)::bigint n_bytes, 0::bigint n_overfull from documents",
    "p9_found": _LEAKS,
    "p10_joined": "select doc_id, md5(coalesce(text, '')) digest, 0::bigint n_over from documents",
}
