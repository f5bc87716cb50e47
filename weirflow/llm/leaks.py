"""Held-out test passages inside a corpus: which documents hold which items.

Both sides are reduced to a stream of their letters a-z and digits, in lower case, with character references (&nbsp;) resolved. Case,
punctuation, blanks and line breaks are gone then, and so are characters outside ASCII, which a wrong charset turns into others
outside ASCII. A shingle is SHINGLE letters of the stream, the length of about five words, at every position: words run together or
torn apart don't matter.

1. One pass over the corpus finds, with a rolling hash, every document that has item shingles, and which.
2. Shingles are ordered by rarity: the number of documents of the whole corpus that have them.
3. A document that shares s shingles with an item shares at least one of its n - s + 1 rarest. Only these, the item's
   prefix, are joined with the documents' shingles. s is small by default: an item changed at every few words has few shingles left.
4. What is left is verified letter by letter on the whole document: runs of at least SHORT equal letters are chained over gaps of
   about a word, and the item's words that lie in chains inside one window are counted.

Items travel to the tasks as arrays of hashes. An item set of more than BLOCK_SHINGLES shingles is taken in blocks, each a pass of
its own, so what is sent has a bound; all items and all documents are always compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.runtime import cut

SHINGLE = 24
#: Letters in a row that a passage holds on to between two disturbances.
SHORT = 12
#: Letters of a changed or inserted word that a chain may skip.
GAP = 24
#: Lengths of an item within which its shorter passages must begin in a document, in any order, with other text between.
WINDOW = 4
#: Share of an item's words that must lie in passages.
SHARE = 0.5
#: Share of an item's shingles that a document must have to be looked at, besides one of them.
SHINGLE_SHARE = 0.005
#: Words in a row that at least one passage must exceed.
QUOTE = 12
BLOCK_SHINGLES = 2_000_000
#: Pairs of equal places of a document and an item that the verifier holds at once.
PAIRS = 1 << 21
_CHUNK = 1 << 21
_DROP = bytes(b for b in range(256) if not (48 <= b <= 57 or 97 <= b <= 122))


def letters(text: str | None) -> bytes:
    """The letters a-z and digits of a text, in lower case. Character references count as what they stand for."""
    text = (text or "").lower()
    if "&" in text:
        text = unescape(unescape(text)).lower()  # pages hold some that are escaped twice
    return text.encode("ascii", "ignore").translate(None, _DROP)


def item_words(text: str | None) -> tuple[bytes, np.ndarray]:
    """An item's letters and where its words begin, with the end at last."""
    words = [w for w in map(letters, (text or "").split()) if w]
    return b"".join(words), np.cumsum([0, *map(len, words)])


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    return np.random.default_rng(20_110_103).integers(1, 2**64, 256, np.uint64)


def _hashes(stream: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of each window of `width` bytes, built from windows of 1, 2, 4, 8 and 16."""
    if len(stream) < width:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        block, size, factor = _table()[stream], 1, np.uint64(0x9E3779B97F4A7C15)
        done, have = None, 0
        while True:
            if width & size:
                done = block if done is None else done[: len(block) - have] * factor + block[have:] if have else block
                have += size
                done = done[: len(stream) - have + 1]
            if have == width:
                break
            block, factor, size = block[:-size] * factor + block[size:], factor * factor, size * 2
        return done ^ (done >> np.uint64(29))


def _find_documents(known: np.ndarray, ids: list, streams: list[bytes]) -> Iterator[tuple]:
    """(id, letters, hashes of its item shingles) of each document with item shingles."""
    seen = np.zeros(1 << 22, bool)
    seen[(known >> np.uint64(42)).astype(np.int64)] = True
    whole = np.frombuffer(b"".join(streams), np.uint8)
    ends = np.cumsum([len(s) for s in streams])
    hashed = _hashes(whole)
    at = np.flatnonzero(seen[(hashed >> np.uint64(42)).astype(np.int64)])
    if not len(at):
        return
    slot = np.searchsorted(known, hashed[at])
    at = at[known[np.minimum(slot, len(known) - 1)] == hashed[at]]
    doc = np.searchsorted(ends, at, "right")
    inside = at + SHINGLE <= ends[doc]
    at, doc = at[inside], doc[inside]
    for d in np.unique(doc):
        mine = at[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")]
        yield ids[d], streams[d].decode(), np.unique(hashed[mine]).view(np.int64)


_HITS = "doc_id long, letters string, shingles array<long>"


def _scan(known: np.ndarray):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: list, streams: list[bytes]) -> Iterator[pa.RecordBatch]:
            found = list(_find_documents(known, ids, streams))
            if found:
                doc, stream, shingles = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(stream, pa.string()), pa.array(shingles, pa.list_(pa.int64()))], names=["doc_id", "letters", "shingles"])

        for b in batches:
            ids, streams, held = [], [], 0
            for i, t in zip(b["doc_id"].to_pylist(), b["text"]):
                stream = letters(t.as_py())
                if len(stream) >= SHINGLE:
                    ids.append(i), streams.append(stream)
                    held += len(stream)
                if held >= _CHUNK:
                    yield from out(ids, streams)
                    ids, streams, held = [], [], 0
            if ids:
                yield from out(ids, streams)

    return scan


def item_shingles(items: DataFrame) -> DataFrame:
    """item_id, shingle (hash): the distinct shingles of each item."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b["item_id"].to_pylist(), b["item_text"].to_pylist()):
                own = np.unique(_hashes(np.frombuffer(item_words(t)[0], np.uint8))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(own), pa.int64()), pa.array(own)], names=["item_id", "shingle"])

    return items.mapInArrow(make, "item_id long, shingle long")


def _runs(item: bytes, doc: bytes) -> list[tuple[int, int, int]]:
    """(place in the document, place in the item, length) of all longest runs of at least SHORT equal letters, by place in the document.

    A text that repeats itself matches an item at many places at once: pairs of places are made of PAIRS at a time.
    """
    own, hashed = (_hashes(np.frombuffer(t, np.uint8), SHORT) for t in (item, doc))
    if not len(own) or not len(hashed):
        return []
    order = np.argsort(own, kind="stable")
    own = own[order]
    low = np.searchsorted(own, hashed, "left")
    many = np.searchsorted(own, hashed, "right") - low
    hit = np.flatnonzero(many)
    upto = np.cumsum(many[hit])
    runs: list[list[int]] = []
    open_at: dict[int, list[int]] = {}  # diagonal -> run that reached the last place looked at
    begin = 0
    while begin < len(hit):
        base = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, base + PAIRS, "right")))
        at, n = hit[begin:end], many[hit[begin:end]]
        p = np.repeat(at, n)
        within = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
        q = order[np.repeat(low[at], n) + within]
        ranked = np.lexsort((p, p - q))
        p, q = p[ranked], q[ranked]
        first = np.ones(len(p), bool)
        first[1:] = (np.diff(p) != 1) | (np.diff(p - q) != 0)
        heads = np.flatnonzero(first)
        sizes = np.diff(np.append(heads, len(p)))
        reach, still = int(at[-1]), {}
        before = int(hit[begin - 1]) if begin else -2
        for x, y, size in zip(p[heads].tolist(), q[heads].tolist(), sizes.tolist()):
            run = open_at.get(x - y) if x == before + 1 else None
            if run is None:
                run = [x, y, SHORT - 1]
                runs.append(run)
            run[2] += size
            if x + size - 1 == reach:
                still[x - y] = run
        open_at, begin = still, end
    return sorted(map(tuple, runs))


def _chains(runs: list[tuple[int, int, int]]) -> list[list]:
    """Runs joined over gaps of a word: [document from, to, item from, to, spans of the item, ends of the last long run in document and item]."""
    chains: list[list] = []
    active: list[list] = []  # those a run may still join, as runs come in order
    for p, q, n in runs:
        long = n >= SHINGLE
        active = [c for c in active if p - c[1] <= GAP]
        for c in reversed(active):
            if p - c[1] >= -SHINGLE and -SHINGLE <= q - c[3] <= GAP and q >= c[2]:
                near = long and c[5] is not None and p - c[5][0] <= GAP and q - c[5][1] <= GAP
                c[4].append((min(q, c[5][1]) if near else q, q + n))
                c[1], c[3] = max(c[1], p + n), max(c[3], q + n)
                break
        else:
            c = [p, p + n, q, q + n, [(q, q + n)], None]
            chains.append(c)
            active.append(c)
        if long:
            c[5] = (max(p + n, c[5][0]), max(q + n, c[5][1])) if c[5] else (p + n, q + n)
    return chains


def passages(item: bytes, starts: np.ndarray, stretches: list[tuple[int, bytes]]) -> tuple[int, int]:
    """(words, longest): most of the item's words that passages of the document hold, and the words of its longest passage.

    A passage is a chain of runs of at least SHORT equal letters that has one of SHINGLE or holds more than QUOTE words. Changed words
    between two runs of SHINGLE belong to it; beside shorter runs only equal letters do, as texts of one pattern differ in just such
    gaps. A word counts when at least half of its letters belong to a passage. Passages of more than QUOTE words count wherever
    they stand; shorter ones, which a phrase in common may make, where they begin within one window of the document.
    """
    sizes = np.diff(starts)
    covered = np.zeros(len(item) + 1, np.int64)  # how many chosen passages hold each letter

    def put(chain: list, by: int) -> None:
        for x, y in chain[4]:
            covered[x:y] += by

    def words() -> int:
        sums = np.concatenate([[0], np.cumsum(covered > 0)])
        return int(((sums[starts[1:]] - sums[starts[:-1]]) * 2 >= sizes).sum())

    long, short = [], []
    for c in _chains([(at + p, q, n) for at, text in stretches for p, q, n in _runs(item, text)]):
        if c[5] or len(c[4]) > 1:
            put(c, 1)
            held = words()
            put(c, -1)
            if held > QUOTE:
                long.append((c, held))
            elif c[5]:
                short.append((c, held))
    for c, _ in long:
        put(c, 1)
    longest = max((n for _, n in long), default=0)
    best = (words(), longest)
    ahead = 0
    for k, (c, _) in enumerate(short):
        while ahead < len(short) and short[ahead][0][0] <= c[0] + WINDOW * len(item):
            put(short[ahead][0], 1)
            ahead += 1
        best = max(best, (words(), longest or max(n for _, n in short[k:ahead])))
        put(c, -1)
    return best


class _Item:
    """An item as the verifier needs it."""

    def __init__(self, text: str | None) -> None:
        self.stream, self.starts = item_words(text)
        self.words, self.sizes = len(self.starts) - 1, np.diff(self.starts)
        self.short = _hashes(np.frombuffer(self.stream, np.uint8), SHORT)

    def most(self, known: np.ndarray) -> int:
        """A bound on the words that passages of a document can hold, from the sorted hashes of its SHORT letters alone: order and place left out."""
        if not len(known) or not len(self.short):
            return 0
        at = np.searchsorted(known, self.short)
        here = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == self.short)
        if not len(here):
            return 0
        # stretches of letters, and gaps that a chain may skip
        first = np.flatnonzero(np.append(True, np.diff(here) > SHORT + GAP))
        last = np.append(first[1:], len(here)) - 1
        edge = np.zeros(len(self.stream) + 1, np.int64)
        edge[here[first]] += 1
        edge[here[last] + SHORT] -= 1
        sums = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1])])
        return int(((sums[self.starts[1:]] - sums[self.starts[:-1]]) * 2 >= self.sizes).sum())


def _verify(share: float, texts: dict[int, str]):
    """(doc_id, letters, item_ids) to the pairs that pass."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: dict[int, _Item] = {}
        for b in batches:
            doc, item, held, of = [], [], [], []
            for d, letters_of, ids in zip(b["doc_id"].to_pylist(), b["letters"].to_pylist(), b["item_ids"].to_pylist()):
                stream = letters_of.encode()
                known = np.unique(_hashes(np.frombuffer(stream, np.uint8), SHORT))
                for i in ids:
                    if i not in items:
                        items[i] = _Item(texts[i])
                    it = items[i]
                    if it.most(known) < share * it.words:
                        continue
                    words, longest = passages(it.stream, it.starts, [(0, stream)])
                    if words >= share * it.words and longest > min(QUOTE, ceil(share * it.words) - 1):
                        doc.append(d), item.append(i), held.append(words), of.append(it.words)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(held, pa.int32()), pa.array(of, pa.int32())], names=["doc_id", "item_id", "n_words", "of_words"])

    return verify


def _candidates(docs: DataFrame, shingles: DataFrame, shingle_share: float) -> tuple[DataFrame, DataFrame]:
    """(documents with item shingles, pairs to be verified)."""
    column = shingles.select("shingle").distinct().toArrow()["shingle"]
    known = np.sort(column.to_numpy().astype(np.int64).view(np.uint64))
    hits = cut(docs.mapInArrow(_scan(known), _HITS))
    seen = hits.select("doc_id", F.explode("shingles").alias("shingle"))
    rarity = seen.groupBy("shingle").agg(F.count(F.lit(1)).alias("n_docs"))
    by_item = Window.partitionBy("item_id")
    ranked = shingles.join(rarity, "shingle", "left").select(
        "item_id", "shingle", F.row_number().over(by_item.orderBy(F.coalesce("n_docs", F.lit(0)), "shingle")).alias("rank"), F.count(F.lit(1)).over(by_item).alias("n")
    )
    ranked = ranked.withColumn("needed", F.greatest(F.lit(1), F.ceil(F.col("n") * shingle_share)))
    # the last shingle of the prefix that a document may begin with leaves just as many behind it as are needed
    prefix = ranked.where("rank <= n - needed + 1").select("item_id", "shingle", "needed")
    return hits, seen.join(prefix, "shingle").groupBy("doc_id", "item_id").agg(F.max("needed").alias("needed"))


def _one_block(docs: DataFrame, items: DataFrame, shingles: DataFrame, share: float, shingle_share: float) -> DataFrame:
    hits, pairs = _candidates(docs, shingles, shingle_share)
    # a document goes to its task once, with the items to look for, of which a block has no more than BLOCK_SHINGLES letters or so
    asked = pairs.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "needed")).alias("asked")).join(hits, "doc_id")
    ids = F.transform(F.filter("asked", lambda a: a["needed"] <= F.size("shingles")), lambda a: a["item_id"])
    texts = items.toArrow()
    wanted = dict(zip(texts["item_id"].to_pylist(), texts["item_text"].to_pylist()))
    return asked.select("doc_id", "letters", ids.alias("item_ids")).mapInArrow(_verify(share, wanted), "doc_id long, item_id long, n_words int, of_words int")


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", share: float = SHARE, shingle_share: float = SHINGLE_SHARE, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, item_id, n_words, of_words: documents that hold at least `share` of an item's words as passages, and how many of how many.

    A passage is a chain of runs of at least SHORT equal letters (passages). A document without any SHINGLE letters of the item in a row
    isn't looked at. At least one passage must be longer than QUOTE words (or than just under `share` of a shorter item), so stock phrases and quotations are no
    case. Null and empty texts hold nothing; items with less than SHINGLE letters can't be found. A document or item id that
    recurs is reported once, with its best row; null ids are left out.
    """
    d = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).where("doc_id is not null and text is not null")
    i = items.select(items[item_id].cast("long").alias("item_id"), items[item_text].cast("string").alias("item_text")).where("item_id is not null and item_text is not null")
    i = i.groupBy("item_id").agg(F.max("item_text").alias("item_text"))
    shingles = cut(item_shingles(i))
    blocks = max(1, ceil(shingles.count() / block_shingles))
    found = None
    for b in range(blocks):
        mine = F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b
        part = _one_block(d, i.where(mine), shingles.where(mine), share, shingle_share)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"), F.max("of_words").alias("of_words"))
