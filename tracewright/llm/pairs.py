"""Defective replies of request-reply pairs: empty, refusal, copied, truncated, in another language."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.endings import BLANKS, MARK, open_marks, stops_early
from tracewright.llm.language import language
from tracewright.llm.refusals import refuses

#: Words in a shingle, and the share of a reply's shingles that must lie in the request before it is aligned.
SHINGLE, CONTAINED = 5, 0.5
#: A copy has at least this share of its words from the request, in order, and covers that share of it.
FROM_REQUEST, OF_REQUEST = 0.8, 0.7

#: Replies that say nothing. Each is compared as a whole, in lower case, with single blanks.
PLACEHOLDERS = frozenset((
    "-", "--", "---", ".", "..", "...", "…", "?", "n/a", "none", "null", "nil", "nan", "undefined", "empty", "nothing", "todo", "tbd", "tba", "wip", "placeholder",
    "{}", "[]", '""', "\'\'", "<empty>", "(empty)", "[empty]", "<none>", "(none)", "[none]", "<null>", "(null)",
    "no answer", "<no answer>", "(no answer)", "[no answer]", "no output", "<no output>", "(no output)", "[no output]", "no changes", "<no changes>", "(no changes)", "[no changes]",
    "no change", "no reply", "<no reply>", "(no reply)", "[no reply]", "no response", "<no response>", "(no response)", "[no response]", "not available", "no patch", "<no patch>", "(no patch)", "[no patch]",
))

_TOKEN = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힯]|[^\W_぀-ヿ㐀-䶿一-鿿가-힯]+(?:['’][^\W\d_]+)?")
_FENCES = re.compile(r"^\s*(?:```|~~~)[\w+-]*\s*$", re.MULTILINE)
_HUNK = re.compile(r"^@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@")
_OTHER_CHANGE = re.compile(r"^(?:rename (?:from|to) |copy (?:from|to) |new file mode |deleted file mode |old mode |new mode |Binary files |GIT binary patch)")
_FILE_HEAD = re.compile(r"^(?:diff --git |index [0-9a-f]|--- |\+\+\+ |similarity index |dissimilarity index )")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.casefold().replace("’", "'"))


def lcs(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence; the table's rows are bits of one integer."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def copies(request: Sequence[str], reply: Sequence[str]) -> bool:
    """Whether a reply gives back all or nearly all of the request and adds nothing.

    Shingle containment first; only a reply most of whose shingles lie in the request is aligned.
    """
    if not request or not reply:
        return False
    k = min(SHINGLE, len(request), len(reply))
    held = {tuple(request[i : i + k]) for i in range(len(request) - k + 1)}
    own = {tuple(reply[i : i + k]) for i in range(len(reply) - k + 1)}
    if len(own & held) < CONTAINED * len(own) or len(own & held) < CONTAINED * len(held):
        return False
    common = lcs(request, reply)
    return common >= FROM_REQUEST * len(reply) and common >= OF_REQUEST * len(request)


def blank_reply(text: str | None) -> bool:
    """Nothing, blanks, fences around nothing, or a placeholder."""
    if text is None:
        return True
    inner = _FENCES.sub("", text).strip(BLANKS)
    return not inner or " ".join(inner.lower().split()) in PLACEHOLDERS


def diff_defect(patch: str) -> str | None:
    """``empty``, ``truncated`` or None of a unified diff; ``prose`` if the text is no diff.

    Hunks must hold as many old and new lines as their heads announce. A diff whose hunks change
    nothing, or that has file heads only, is empty; renamed, new, deleted, mode and binary files
    need no hunk.
    """
    lines = patch.split("\n")
    whole_end = patch.endswith("\n")
    if whole_end:
        lines.pop()
    if not any(line.startswith(("diff --git a/", "--- ", "@@ -", "diff --git \"a/")) for line in lines):
        return "prose"
    removed: Counter[str] = Counter()
    added: Counter[str] = Counter()
    other = False
    section_done = True  # the current file has a hunk or needs none
    i = 0
    while i < len(lines):
        line = lines[i]
        i += 1
        if line.startswith("diff --git"):
            section_done = False
            continue
        if _OTHER_CHANGE.match(line):
            other = section_done = True
            continue
        m = _HUNK.match(line)
        if not m:
            continue
        section_done = True
        old, new = (int(x) if x is not None else 1 for x in m.groups())
        while i < len(lines) and (old > 0 or new > 0):
            line = lines[i]
            if line.startswith("+"):
                new -= 1
                added[line[1:]] += 1
            elif line.startswith("-"):
                old -= 1
                removed[line[1:]] += 1
            elif line.startswith(" ") or line == "":
                old -= 1
                new -= 1
            elif not line.startswith("\\"):
                break
            i += 1
        if old > 0 or new > 0:
            return "truncated"
    last = lines[-1] if lines else ""
    if MARK.search(last.strip()) or last.strip() in ("...", "…"):
        return "truncated"
    changed = removed != added
    if not section_done and (changed or other or not whole_end):
        return "truncated"
    if not whole_end and (re.match(r"^@@[^@]*$", last) or re.match(r"^(?:---|\+\+\+)(?: [ab]?/?)?$", last)):
        return "truncated"
    if not changed and not other:
        return "empty"
    if not whole_end and last[:1] in "+- " and open_marks(last[1:]):
        return "truncated"
    return None


def submission_defect(issue: str | None, reply: str | None, request: list[str], request_language: str | None) -> str | None:
    if blank_reply(reply):
        return "empty"
    if refuses(reply):
        return "refusal"
    if issue and copies(request, tokens(reply)):
        return "copied"
    if stops_early(reply):
        return "truncated"
    if request_language:
        spoken = language(reply)
        if spoken and spoken != request_language:
            return "other_language"
    return None


def patch_defect(patch: str | None, request: list[str]) -> str | None:
    if blank_reply(patch):
        return "empty"
    body = re.sub(r"^\s*```(?:diff|patch)?\n(.*?)\n?```\s*$", r"\1\n", patch, flags=re.DOTALL)
    found = diff_defect(body)
    if found == "truncated":
        return found
    if found == "empty" or found == "prose":
        prose = "\n".join(re.sub(r"^\s*(?:[+#>]|//)+ ?", "", x) for x in body.split("\n") if not _FILE_HEAD.match(x) and not x.startswith("diff --git"))
        if refuses(prose):
            return "refusal"
        if request and copies(request, tokens(prose)):
            return "copied"
        if found == "empty":
            return found
        return "empty" if blank_reply(prose) else None
    return None


SCHEMA = "traj_id bigint, field_name string, defect string"


def _defects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows, known = [], {}
        for key, issue, submission, patch in zip(batch["traj_id"], batch["issue"], batch["submission"], batch["patch"]):
            if issue not in known:
                known[issue] = (tokens(issue), language(issue)) if issue else ([], None)
            request, spoken = known[issue]
            for field, defect in (("submission", submission_defect(issue, submission, request, spoken)), ("patch", patch_defect(patch, request))):
                if defect:
                    rows.append((key, field, defect))
        yield pd.DataFrame(rows, columns=["traj_id", "field_name", "defect"])


def defective_replies(trajectories: DataFrame) -> DataFrame:
    """(traj_id, field_name, defect) of every reply that is no proper reply to its issue.

    Each pair is judged on its own, so no text is shuffled and no instance is hot. At most one
    defect per reply, in this order: empty, refusal, copied, truncated, other_language (of
    submissions only). Without an issue (null or blank) nothing is copied or in another language.
    Rows without traj_id are left out; repeated rows count once.
    """
    pairs = trajectories.filter("traj_id is not null").select("traj_id", "issue", "submission", "patch")
    return pairs.mapInPandas(_defects, SCHEMA).distinct()
