"""How a text ends: a stack automaton over its structure, and the shape of its last line."""

from __future__ import annotations

import re
from collections import Counter

#: What may follow an author's last word.
CLOSINGS = (
    "thanks", "thank you", "many thanks", "thanks again", "regards", "best regards", "kind regards", "best", "best wishes",
    "cheers", "sincerely", "yours", "yours sincerely", "greetings", "take care", "ciao",
    "danke", "vielen dank", "gruss", "gruß", "viele grüße", "mit freundlichen grüßen", "liebe grüße",
    "gracias", "saludos", "un saludo", "atentamente", "merci", "cordialement", "bien à vous", "salutations",
)

TRAILER = re.compile(r"(?:[A-Z][a-z]+(?:-[a-z]+)*-by|Fixes|Closes|Refs|See-also|Change-Id|Cc|Bug|Issue|Link): ?\S.*\S")
FENCE = re.compile(r"^[ \t>]*(`{3,}|~{3,})([^\n`]*)$", re.MULTILINE)
LOG_LINE = re.compile(r"\[?\d{4}-\d\d-\d\d[ T]\d\d:\d\d\S*\]? +\[?(?:TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|FATAL|CRITICAL)\b")
LOG_END = re.compile(
    r"exit(?:ed)?(?: with)? (?:status|code) \d+|=+ .* =+|done, \d+ .*\w|process finished.*|\d+ (?:passed|failed)\b.*\w|(?:build|tests?) (?:succeeded|failed|passed)",
    re.IGNORECASE,
)
#: Marks that only a cut leaves behind.
MARK = re.compile(
    r"(?:\[ ?(?:\.\.\.|…|cut|snip\w*|truncated|shortened|clipped)[^\]\n]{0,40}\]"
    r"|< ?(?:\.\.\.|…|cut|snip\w*|truncated|shortened|clipped)[^>\n]{0,40}>"
    r"|\((?:\w+ ){0,3}(?:shortened|truncated|cut off|cut|clipped|continued|snipped)\)"
    r"|\[?(?:read|show|see) more\]?)$",
    re.IGNORECASE,
)
ELLIPSIS = re.compile(r"(?:…|\.\.\.)$")
STOP = re.compile(r"[.!?。！？；;:]?[.!?。！？][\"'”’»)\]*_`」』]*$")
BULLET = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+")
BROKEN = re.compile(r"(?:\ufffd|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|&#?\w{0,6}|<[A-Za-z/][^<>\n]{0,80}|%[0-9A-Fa-f]?)$")
#: Endings of file names that stand for a whole path.
EXTENSIONS = frozenset(
    "py pyi pyx ts tsx ets js jsx mjs cjs java kt kts go rs c h cc cpp hpp cs rb php swift scala sh bash zsh ps1 sql "
    "md rst txt json jsonl yaml yml toml ini cfg conf xml html htm css scss vue svelte lua pl r jl dart ex exs erl hs "
    "clj groovy gradle proto lock log csv tsv parquet ipynb png svg jpg pdf zip gz".split()
)
BLANKS = " \t\r\n\f\v\u00a0\u200b\ufeff\u2028\u2029\u3000"


def open_fence(text: str) -> bool:
    """Whether a fenced block is still open at the end. The automaton's stack holds the fence that must close it."""
    stack: list[str] = []
    for m in FENCE.finditer(text):
        mark, rest = m.group(1), m.group(2).strip()
        if not stack:
            stack.append(mark)
        elif mark[0] == stack[-1][0] and len(mark) >= len(stack[-1]) and not rest:
            stack.pop()
    return bool(stack)


PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«", "」": "「", "』": "『"}
OPENERS = frozenset(PAIRS.values())
#: Elements whose end tag may not be left out.
ELEMENTS = frozenset(
    "html head body table thead tbody tfoot ul ol dl div span pre code details summary blockquote section article header footer nav main aside figure figcaption "
    "a b i u s em strong small sub sup kbd samp var mark h1 h2 h3 h4 h5 h6 script style svg button form select textarea label fieldset video audio picture".split()
)
_TAG = re.compile(r"<(/?)([A-Za-z][\w:-]*)(?:\s[^<>]*)?(/?)>")
_END_TAG = re.compile(r"</([A-Za-z][\w:-]*)>")
_FACE = re.compile(r"[:;=][-o']?[()\[\]{}]+")
_CODE_LINE = re.compile(r"(?: {4}|\t|\[?\d{4}-\d\d-\d\d[ T]\d\d:\d\d|\s*at \S+\(|[+-] )")
_STRUCTURE = re.compile(r"[()\[\]{}“”«»「」『』\"`<]")


def open_marks(line: str) -> bool:
    """Whether a bracket, quotation mark or code tick opened in ``line`` is not closed in it."""
    stack: list[str] = []
    for ch in _STRUCTURE.findall(line):
        if stack and stack[-1] == "`":
            if ch == "`":
                stack.pop()
        elif ch == "`":
            stack.append(ch)
        elif ch == '"':
            if stack and stack[-1] == '"':
                stack.pop()
            else:
                stack.append(ch)
        elif ch in OPENERS:
            stack.append(ch)
        elif ch in PAIRS and stack and stack[-1] == PAIRS[ch]:
            stack.pop()
    return bool(stack)


def open_structure(text: str) -> bool:
    """Whether a bracket, quotation mark or markup element that a text opens anywhere is still open at its end.

    One stack is carried over the whole text. Fenced blocks are stepped over, and it recovers at the
    start of lines that are code, log or diff, whose marks count for nothing. Round brackets and straight
    quotation marks belong to a paragraph, code ticks to a line; all else stays open until it is
    closed. A closing mark closes what was opened above its partner; one without partner (the ``)``
    of a numbered list) is ignored. An element counts if its end tag may not be left out, or if its
    name has an end tag anywhere in the text.
    """
    if not _STRUCTURE.search(text):
        return False
    ended = {m.lower() for m in _END_TAG.findall(text)} if "</" in text else set()
    stack: list[str] = []
    held: Counter[str] = Counter()  # what the stack holds, so that no mark searches it
    fence: str | None = None

    def push(mark: str) -> None:
        stack.append(mark)
        held[mark] += 1

    def close(mark: str) -> None:
        while held[mark]:
            top = stack.pop()
            held[top] -= 1
            if top == mark:
                return

    for raw in text.split("\n"):
        m = FENCE.match(raw)
        if m:
            mark, rest = m.group(1), m.group(2).strip()
            if fence is None:
                fence = mark
            elif mark[0] == fence[0] and len(mark) >= len(fence) and not rest:
                fence = None
            continue
        if fence is not None:
            continue
        line = raw.lstrip("> ") if raw.startswith(">") else raw
        if not line.strip():
            if held["("] or held['"']:
                stack = [x for x in stack if x not in '("']
                held["("] = held['"'] = 0
            continue
        if not _STRUCTURE.search(line) or _CODE_LINE.match(line):
            continue
        if "`" in line:
            line = " ".join(line.split("`")[::2])
        if "<" in line:
            for end, name, alone in _TAG.findall(line):
                name = name.lower()
                if alone or name not in ELEMENTS and name not in ended:
                    continue
                close(f"<{name}") if end else push(f"<{name}")
            line = _TAG.sub(" ", line)
        line = _FACE.sub(" ", line)
        before = ""
        for ch in line:
            if ch == '"':
                if held[ch]:
                    close(ch)
                elif not before.isdigit():  # an inch
                    push(ch)
            elif ch in OPENERS:
                if ch not in "“«" or not held[ch]:  # each paragraph of a long quotation opens it again
                    push(ch)
            elif ch in PAIRS:
                close(PAIRS[ch])
            before = ch
    return bool(stack)


_PATH_SIGNS = frozenset("._@~/\\-")
_PATH_TAIL = re.compile(r"\.(?P<ext>[A-Za-z]\w{0,6})(?P<lines>:\d+(?:-\d+)?)?[)\]`]?$")


def path_end(word: str) -> tuple[str, str | None] | None:
    """Suffix and line range of the path, with at least one folder, that a word ends with; None without one."""
    m = _PATH_TAIL.search(word[-40:])
    if not m:
        return None
    at = len(word) - (len(word[-40:]) - m.start()) - 1
    name = at
    while at >= 0 and (word[at].isalnum() or word[at] in _PATH_SIGNS):
        if word[at] in "/\\" and at < name:
            return m["ext"], m["lines"]
        at -= 1
    return None


def ending(text: str) -> str:
    """``whole``, ``cut``, ``loose`` or ``log``.

    ``loose``: the last line proves neither; whether its source ends texts with that very line
    decides. ``log``: the text ends on an entry of a log, which whole logs of its source may never do.
    """
    body = text.rstrip(BLANKS)
    if not body:
        return "whole"
    cut_at = body.rfind("\n")
    line = body[cut_at + 1 :].strip(BLANKS)
    if open_fence(body):
        return "cut"
    if MARK.search(line):
        return "cut"
    if FENCE.match(line):
        return "whole"
    if open_structure(body):
        return "cut"
    quoted = line.lstrip("> \t")
    if ELLIPSIS.search(quoted):
        return "loose"
    if LOG_END.fullmatch(quoted):
        return "whole"
    if LOG_LINE.match(quoted):
        return "log" if STOP.search(quoted) else "cut"
    if STOP.search(quoted):
        return "whole"
    bullet = BULLET.match(line)
    words = quoted[bullet.end() :].split() if bullet else quoted.split()
    path = path_end(words[-1]) if words else None
    if path and path[0].lower() in EXTENSIONS:
        lone = len(words) == 1 or (len(words) <= 4 and re.match(r"(?i)(see|also|refs?|files?|source|cf|siehe|voir|véase)\b", words[0]))
        if lone:
            lines = path[1]
            if lines and "-" in lines:
                a, b = map(int, lines[1:].split("-"))
                return "whole" if a <= b else "cut"
            if bullet and cut_at >= 0:  # like the entries above it?
                above = body[:cut_at].rstrip(BLANKS).rpartition("\n")[2].strip(BLANKS)
                if BULLET.match(above) and re.search(r":\d+-\d+$", above):
                    return "cut"
            return "whole"
        return "cut"
    if TRAILER.fullmatch(quoted):
        return "whole"
    if cut_at >= 0 and not bullet and len(words) <= 4 and not BROKEN.search(quoted):
        above = body[:cut_at].rpartition("\n")[2].strip(BLANKS).rstrip(",.! –-").lower()
        if above in CLOSINGS:
            return "whole"
    if BROKEN.search(quoted) or open_marks(quoted):
        return "cut"
    return "loose"


def stops_early(text: str) -> bool:
    """:func:`ending` for a text alone, with no source to compare with: whatever is not proved whole stops early."""
    return ending(text) in ("cut", "loose")
