import numpy as np
import pytest

from weirflow.llm import chunking, tokens


def ranks(text):
    return chunking.boundaries(np.frombuffer(text.encode("utf-32-le"), np.uint32))


SECTION = " ".join(f"The {w} keeper closed the gate of the old mill again." for w in ("first", "second", "third", "fourth", "fifth", "sixth", "seventh"))


@pytest.mark.parametrize("gap", ["\n", "\n\n"])
def test_rank_of_headings(gap):
    text = f"{SECTION}\n\nThe old mill{gap}{SECTION}\n\n{SECTION}"
    rank = ranks(text)
    at = text.index("\n\nThe old mill")
    assert rank[at] == chunking.HEADING
    assert rank[at + 2 + len("The old mill")] < chunking.WORD
    assert rank[text.rindex("\n\n")] == chunking.PARAGRAPH


def test_marked_and_repeated_headings():
    text = f"{SECTION}\n## The old mill\n{SECTION}\n\nTitle\n\nSubtitle\n\n{SECTION}"
    rank = ranks(text)
    assert rank[text.index("\n##")] == chunking.HEADING and rank[text.index("\n", text.index("##"))] < chunking.WORD
    assert [rank[text.index(x)] for x in ("\n\nTitle", "\n\nSubtitle")] == [chunking.HEADING, chunking.SENTENCE]
    assert rank[text.index("\n\n", text.index("Subtitle"))] < chunking.WORD


@pytest.mark.parametrize("gap", ["\n", "\n\n"])
def test_pieces_keep_headings_with_their_sections(gap):
    coder = tokens.encoding()
    text = "\n\n".join(f"Chapter {k} of the mill{gap}" + "\n\n".join([SECTION] * (1 + k % 4)) for k in range(40))
    pieces = chunking.cut_text(text)
    assert "".join(text[own:z] for _, own, z, _ in pieces) == text and all(n == len(coder.encode_ordinary(text[a:z])) <= 512 for a, _, z, n in pieces)
    assert not any(text[:z].rstrip().endswith("of the mill") for _, _, z, _ in pieces[:-1])
    assert sum(text[z:].lstrip().startswith("Chapter") for _, _, z, _ in pieces[:-1]) > 0.8 * (len(pieces) - 1)


@pytest.mark.parametrize("text", ["\n\n", "a\n\n", "\n\na\nb", "# ", "#", "a\n\nb", " a\n\n# b\n\n"])
def test_edges(text):
    assert len(ranks(text)) == len(text) + 1
