import time

import pytest

from tracewright.llm.endings import ending, open_structure, path_end


@pytest.mark.parametrize(
    "text, state",
    [
        ("The loader fails (see the report\nof last week. It is fast.", "cut"), ("The loader fails (see the\nreport). It is fast.", "whole"),
        ('He wrote "this never\nworks. We saw it.', "cut"), ('He wrote "this never\nworks". We saw it.', "whole"), ("He wrote “this never works.\n\nWe saw it.", "cut"),
        ("<table>\n<tr><td>1</td></tr>\n\nThat is all.", "cut"), ("<table>\n<tr><td>1</td></tr>\n</table>\n\nThat is all.", "whole"), ("<note>\nOne.\n</note>\n<note>\nTwo.", "cut"),
        ("A List<String> is kept.\n\nIt works.", "whole"), ("We do two things:\n1) load\n2) store\n\nIt works.", "whole"), ("It works :)\n\nIt fails :(\n\nDone.", "whole"),
        ("A 5\" disk.\n\nIt works.", "whole"), ("The list [1, 2\n\nis long.", "cut"), ("The list [1, 2]\n\nis long.", "whole"), ("A note (open here.\n\nIt works.", "whole"),
        ("Log:\n    call(x, [1\n\nIt works.", "whole"), ("```\nf(\n```\n\nIt works.", "whole"), ("Call `f(` twice.\n\nIt works.", "whole"), ("2024-01-02 10:00:00 INFO a.b open (\nIt works.", "whole"),
        ("“One paragraph.\n\n“Two paragraphs.”\n\nIt works.", "whole"), ("He said 「好\n\nIt works.", "cut"), ("<br>\n<img src='x'>\nIt works.", "whole"), ("<div/>It works.", "whole"),
    ],
)
def test_whole_texts(text, state):
    assert ending(text) == state


def test_paths():
    assert path_end("src/a.py") == ("py", None) and path_end("(src/a.py:3-9)") == ("py", ":3-9") and path_end("x\\y.ts`") == ("ts", None)
    assert path_end("a.py") is None and path_end("src/a") is None and path_end("src/") is None and path_end("") is None
    assert path_end("d/" * 5000 + "a.py") == ("py", None) and path_end("x" * 100_000 + ".py") is None


def test_very_long_texts():
    began = time.time()
    for text in ("(" * 200_000, "<div>" * 50_000, "[(" * 50_000 + ")]" * 50_000, '"' * 100_001, "word (" * 100_000, "“" * 100_000, "(" * 100_000 + "]" * 100_000, ")" * 100_000 + "{" * 100_000, "[\n\n(" * 20_000, "a/" * 200_000 + "b.py"):
        ending(text)
    assert not open_structure("") and time.time() - began < 20
