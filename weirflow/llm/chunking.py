"""Cutting texts that are larger than a limit, at natural boundaries, with overlap, by their content.

A rolling hash over the last bytes marks landmarks. From each cut, the landmark with the least hash between the minimum size and the limit is taken and
moved to the nearest natural boundary: before a heading, else the end of a paragraph, else of a sentence or line, else a word's end. A heading isn't parted
from what follows it while there is a word's end to cut at. What a cut depends on
lies near it, so an edit alters the pieces around it while later cuts find the same landmarks again. Where a stretch
has no blanks at all, punctuation and at last single characters are cut between.

Sizes are in tokens of a public tokenizer. Cuts before white space fall between the tokenizer's own units, so a piece has exactly the
tokens it has inside the text; other cuts are checked by encoding the piece, and moved until it fits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weirflow.llm.tokens import RANKS, encoding, token_bytes

LIMIT = 512
OVERLAP = 64
WINDOW_BYTES = 32
#: One landmark in so many bytes, on average.
LANDMARK_EVERY = 64
#: Share of the room that a piece fills at least, where there is a boundary to cut at.
LEAST = 0.5
#: Tokens by which an overlap may be longer so as to begin at a word.
SLACK = 16
#: Most characters of a heading.
HEADING_CHARS = 100
HEADING, PARAGRAPH, SENTENCE, WORD, MARK, ANY = 5, 4, 3, 2, 1, 0
SCHEMA = "doc_id long, piece_no int, char_start int, own_start int, char_end int, n_tokens int, piece_text string"
# fixed values: ends of sentences in several scripts, and closing marks that may follow them
_ENDS = [ord(c) for c in ".!?…。！？｡"]
_CLOSING = [ord(c) for c in "\"')]»”’」』）"]
_BLANKS = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_PAUSES = [ord(c) for c in ",;:|/、〃"]
_BLANK, _END, _CLOSE, _PAUSE = 1, 2, 4, 8


def _rolling(data: np.ndarray) -> np.ndarray:
    """For each byte, a hash of the WINDOW_BYTES up to and with it (fewer at the start)."""
    with np.errstate(over="ignore"):
        h, size, factor = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1, np.uint64(0x9E3779B97F4A7C15)
        while size < WINDOW_BYTES:
            before = np.zeros_like(h)
            before[size:] = h[:-size]
            h, factor, size = before * factor + h, factor * factor, size * 2
        return h ^ (h >> np.uint64(31))


def _kinds() -> np.ndarray:
    """What each code point below 65,536 is; others are plain."""
    kinds = np.zeros(1 << 16, np.uint8)
    kinds[_BLANKS] = _BLANK
    kinds[_CLOSING] = _CLOSE | _PAUSE
    kinds[_ENDS] = _END | _PAUSE
    kinds[_PAUSES] |= _PAUSE
    kinds[39] &= ~np.uint8(_PAUSE)  # an apostrophe may stand inside a unit of the tokenizer
    return kinds


_KINDS = _kinds()


def _headings(points: np.ndarray, kind: np.ndarray, at: np.ndarray, till: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the blank runs at..till: those before headings, those between two, and those after.

    A heading is a short line without an end mark that stands by itself, or at the head of a longer line after a blank line, or a line
    that begins with # and a blank. Of several in a row only the first has a cut before it.
    """
    n = len(points)
    run = np.flatnonzero(breaks > 0)
    first = int(np.argmax(kind != _BLANK))
    start, end = np.concatenate([[first], till[run]]), np.append(at[run], n)
    length = end - start  # 0 for what follows the last run, if it ends the text
    ahead, behind = np.concatenate([[2], breaks[run]]), np.append(breaks[run], 0)
    close = np.maximum(end - 1, 0)
    last = kind[close]
    ended = (last & _END > 0) | ((last & _CLOSE > 0) & (kind[np.maximum(end - 2, 0)] & _END > 0)) | ((last & _PAUSE > 0) & (last & _CLOSE == 0))
    following = np.append(length[1:], 0)
    plain = (ahead > 1) & ((behind > 1) | (following > length)) & ~ended
    s = np.minimum(start, n - 1)
    hashed = (points[s] == 35) & ((kind[np.minimum(s + 1, n - 1)] == _BLANK) | (points[np.minimum(s + 1, n - 1)] == 35))
    head = (length > 0) & (length <= HEADING_CHARS) & (following > 0) & (plain | hashed)
    before, after = head[1:], head[:-1]
    return run[before & ~after], run[before & after], run[after & ~before]


def boundaries(points: np.ndarray) -> np.ndarray:
    """The rank of a cut before each character (and after the last), from its code points."""
    n = len(points)
    rank = np.zeros(n + 1, np.int8)
    if n < 2:
        return rank
    kind = _KINDS[np.minimum(points, 0xFFFF)]
    blank = kind == _BLANK
    step = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    at = step[blank[step]]  # first blank of a run that follows text
    after = step[~blank[step]]
    till = np.append(after, n)[np.searchsorted(after, at)]
    lines = np.flatnonzero(points == 10)
    breaks = np.searchsorted(lines, till) - np.searchsorted(lines, at)
    last = kind[at - 1]
    closed = (last & _CLOSE > 0) & (at > 1) & (kind[np.maximum(at - 2, 0)] & _END > 0)
    rank[at] = np.where(breaks > 1, PARAGRAPH, np.where((last & _END > 0) | closed | (breaks == 1), SENTENCE, WORD))
    before, between, behind = _headings(points, kind, at, till, breaks)
    rank[at[before]], rank[at[between]], rank[at[behind]] = HEADING, SENTENCE, MARK
    # without blanks: after a mark that a letter or digit follows
    pause = np.flatnonzero(kind[:-1] & _PAUSE)
    inner = pause[kind[pause + 1] == 0] + 1
    rank[inner] = np.where((kind[inner - 1] & _END > 0) & (points[inner - 1] > 127), SENTENCE, MARK)
    return rank


def _snap(rank: np.ndarray, low: int, high: int, want: int) -> int:
    """The boundary in low..high nearest to want: a better kind may lie further off."""
    room = max(1, high - low)
    kinds = rank[low : high + 1]
    for kind, near in ((HEADING, room), (PARAGRAPH, room), (SENTENCE, room // 2), (WORD, room), (MARK, room)):
        at = np.flatnonzero(kinds >= kind) + low
        if len(at):
            best = int(at[np.abs(at - want).argmin()])
            if abs(best - want) <= near:
                return best
    return want


def cut_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, path: str = RANKS) -> list[tuple[int, int, int, int]]:
    """(start, own start, end, tokens) of each piece, in characters: start to own start repeats the piece before."""
    coder = encoding(path)
    data = text.encode("utf-8", "replace")
    if len(data) <= limit and not text:
        return [(0, 0, 0, 0)]
    tokens = np.array(coder.encode_ordinary(text), np.int64)
    if len(tokens) <= limit:
        return [(0, 0, len(text), len(tokens))]
    raw = np.frombuffer(data, np.uint8)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    char_at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # byte at which each character begins
    token_at = np.concatenate([[0], np.cumsum(token_bytes(path)[tokens])])
    before = np.searchsorted(token_at, char_at, "left")  # tokens before a character, a token it cuts counted
    rank = boundaries(points)
    hashed = _rolling(raw)
    marks = np.flatnonzero(hashed % np.uint64(LANDMARK_EVERY) == 0)
    rarity = hashed[marks] // np.uint64(LANDMARK_EVERY)
    marks = np.searchsorted(char_at, marks, "right")  # the character after the landmark's

    def first_char(token: int) -> int:
        """The first character that begins at or after a token's start."""
        return int(np.searchsorted(before, token, "left"))

    def last_char(token: int) -> int:
        return int(np.searchsorted(before, token, "right")) - 1

    def size(a: int, z: int) -> int:
        if (rank[a] >= WORD or a == 0) and (rank[z] >= WORD or z == len(text)):
            return int(before[z] - before[a])
        return len(coder.encode_ordinary(text[a:z]))

    def repeat_from(own: int, end: int) -> int:
        """Where the next piece begins: at a word at or a little before the last `overlap` tokens, else one token before them."""
        if not overlap:
            return end
        wanted = int(before[end]) - overlap
        if wanted <= before[own]:
            return own
        back, far = last_char(wanted), max(own, first_char(wanted - SLACK))
        at = np.flatnonzero(rank[far : back + 1] >= WORD)
        return far + int(at[-1]) if len(at) else max(own, last_char(wanted - 1))

    out: list[tuple[int, int, int, int]] = []
    start = own = 0
    while True:
        if before[-1] - before[start] <= limit and (n := size(start, len(text))) <= limit:
            out.append((start, own, len(text), n))
            return out
        high = last_char(int(before[start]) + limit)
        low = min(high, max(own + 1, first_char(int(before[own]) + int((limit - overlap) * LEAST))))
        k, z = np.searchsorted(marks, (low, high + 1))
        want = int(marks[k + rarity[k:z].argmin()]) if k < z else high
        end = _snap(rank, low, high, want)
        n = size(start, end)
        while n > limit and end > own + 1:
            high = own + max(1, (end - own) * 9 // 10)
            end = _snap(rank, min(low, high), high, high)
            n = size(start, end)
        if n > limit:  # the overlap alone leaves no room here
            start, end = own, own + 1
            n = size(start, end)
        out.append((start, own, end, n))
        start, own = repeat_from(own, end), end


def cut_texts(df: DataFrame, doc_id: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, path: str = RANKS) -> DataFrame:
    """doc_id, piece_no, char_start, own_start, char_end, n_tokens, piece_text of each piece of each text.

    Pieces have at most `limit` tokens, the overlap included. Piece n repeats at least `overlap` tokens of piece n - 1 (char_start to
    own_start), a little more where that begins at a word; the own parts joined up are the text. Texts within the limit are one
    piece. An empty text is one empty piece, a null text one piece with a null piece_text. A single character of more than `limit` tokens isn't cut.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half of the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            names = ["doc_id", "piece_no", "char_start", "own_start", "char_end", "n_tokens", "piece_text"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for b in batches:
            rows: list[tuple] = []
            held = 0
            for i, t in zip(b["doc_id"].to_pylist(), b["text"]):
                t = t.as_py()
                if t is None:
                    rows.append((i, 0, 0, 0, 0, 0, None))
                    continue
                for k, (a, own, z, n) in enumerate(cut_text(t, limit, overlap, path)):
                    rows.append((i, k, a, own, z, n, t[a:z]))
                    held += z - a
                if held > 4 << 20:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    rows = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
