from hypothesis import given, settings
from hypothesis import strategies as st

from lakesift.operators.chunking import chunk, chunk_documents, kind_of

GUIDE = "# Guide\n\nWelcome to this guide. It has several parts.\n\n## Installation\n\nRun the installer. Then restart the machine. It takes a while to finish.\n\n### macOS\n\nUse the package. Open the folder and wait for it.\n\n### Linux\n\nUse your manager. Type the command and confirm.\n\n## Usage\n\nStart the program. It shows a window with a button. Press the button to go on.\n"


def test_sections_and_sizes():
    found = chunk(GUIDE, 120, 20, 30)
    assert len(found) >= 3 and all(n >= 30 for _, n, *_ in found)
    assert any(path == "Guide > Installation > macOS" for _, _, path, *_ in found)


def test_front_matter_counts_in_places():
    text = "---\ntitle: A note\ntags: [x]\n---\n# Head\n\n" + "Words in a row. " * 20
    pos, n, *_ = chunk(text, 2000, 100, 10)[0]
    assert text[pos:pos + n].startswith("# Head")
    assert chunk(text, 2000, 100, 10, compat=True)[0][0] == 0


def test_no_break_inside_a_fence_or_a_table():
    fence = "Intro text here.\n\n```python\n" + "x = 1\n\n" * 20 + "```\n\nAfter the block. More words follow here."
    cuts = {pos for pos, *_ in chunk(fence, 90, 5, 5)}
    assert cuts
    table = "Text before.\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nText after the table that goes on for some time. And on."
    for pos, n, *_ in chunk(table, 45, 0, 1):
        assert n <= 45


def test_kinds():
    assert kind_of("plain") == ("prose", None)
    assert kind_of("```py\nx = 1\n```") == ("code", "py")
    assert kind_of("words\n```js\nx\n```") == ("mixed", "js")


def test_empty_and_short_texts():
    assert chunk("") == [] and chunk("tiny") == []


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="aB. \n#`|-é 😀", max_size=400), st.integers(10, 120), st.integers(0, 9), st.integers(0, 30), st.booleans())
def test_ends_and_moves_on(text, target, overlap, least, compat):
    found = chunk(text, target, overlap, least, compat)
    starts = [pos for pos, *_ in found]
    assert starts == sorted(starts) and len(set(starts)) == len(starts)
    assert all(least <= n <= target for _, n, *_ in found)
    assert all(pos + n <= len(text) for pos, n, *_ in found)


def test_as_rows(spark):
    docs = spark.createDataFrame([("a", GUIDE), ("b", None), ("c", "")], "content_hash string, doc string")
    rows = chunk_documents(docs, target=120, overlap=20, least=30).collect()
    assert {r["content_hash"] for r in rows} == {"a"}
    assert sorted(r["seq"] for r in rows) == list(range(len(rows)))


def test_a_language_that_the_end_of_a_chunk_cuts_is_read_whole():
    text = "```\nold\n```\n" + "word " * 8 + "\n```text\nx\n```\n"
    at = text.index("```text")
    assert kind_of(text, 0, at + 6) == kind_of(text, 0, at + 7) == kind_of(text, 0, at + 8) == ("mixed", "text")
    assert kind_of(text, 0, at + 3) == kind_of(text, 0, at) == ("mixed", None)
