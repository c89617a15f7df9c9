"""What runs read and changed, from commands, tool calls, diffs, logs and answers."""

from __future__ import annotations

import ast
import contextlib
import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.ordering import running_totals

# What counts as a path, a reading command, a file made for a test run.
PATH_SUFFIXES = (
    ".py", ".md", ".txt", ".json", ".yaml", ".yml", ".js", ".jsx", ".ts", ".tsx", ".java", ".kt", ".kts", ".scala", ".swift", ".cs", ".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx", ".m", ".mm",
    ".go", ".rs", ".rb", ".php", ".sh", ".bash", ".zsh", ".html", ".htm", ".css", ".scss", ".less", ".vue", ".svelte", ".xml", ".toml", ".cfg", ".ini", ".gradle", ".sql", ".lua", ".pl", ".pm", ".ex",
    ".exs", ".erl", ".clj", ".dart", ".tf", ".proto",
)
#: Fixed value: beginnings of names that stand for files of a test run, in paths as a whole.
TEMP_BEGINNINGS = ("reproduce", "tmp", "temp", "debug_", "test_reproduce")
#: Suffixes of paths in logged commands.
LOGGED_SUFFIXES = (
    ".py", ".md", ".txt", ".json", ".yaml", ".yml", ".toml", ".cfg", ".js", ".ts", ".jsx", ".tsx", ".html", ".css", ".scss", ".sass", ".java", ".c", ".cpp", ".h", ".hpp", ".go", ".rs", ".rb", ".php",
    ".sh", ".bash", ".zsh", ".fish", ".ps1", ".bat", ".cmd", ".xml", ".sql", ".r", ".m", ".swift", ".kt", ".scala", ".vue", ".svelte", ".dart", ".lua", ".pl", ".pm", ".tcl", ".ini", ".conf", ".config",
    ".properties", ".env", ".lock", ".log", ".out", ".err",
)
READ_COMMANDS = ("cat", "head", "tail", "nl", "less", "more")
VALUE_FLAGS = ("-n", "-c", "-q", "-v")
TEMP_PREFIXES = ("reproduce_", "test_reproduce", "debug_", "tmp_", "temp_", "__pycache__")
EXAMPLE_PREFIXES = ("/path/to/", "/example/")
BASH_BLOCK = r"(?s)```bash\s*\n(.*?)\n```"
SUFFIX_PATTERN = "(?i)(" + "|".join(x.replace(".", r"\.") for x in PATH_SUFFIXES) + ")$"

_TRIM = "'\""


def bash_block(content: Column) -> Column:
    """The first bash block of a message, trimmed; null without one."""
    found = F.trim(F.regexp_extract(content, BASH_BLOCK, 1))
    return F.when(content.rlike(BASH_BLOCK), found)


def command_words(command: Column) -> Column:
    return F.filter(F.split(command, r"\s+"), lambda w: w != "")


def likely_path(word: Column) -> Column:
    w = F.btrim(word, F.lit(_TRIM))
    example = w.startswith(EXAMPLE_PREFIXES[0]) | w.startswith(EXAMPLE_PREFIXES[1])
    return ~example & (w.contains("/") | w.rlike(SUFFIX_PATTERN))


def reads_content(command: Column) -> Column:
    """cat, head, tail, nl, less, more, or sed with -n among the first three words."""
    ws = command_words(F.lower(command))
    first = F.get(ws, 0)
    sed = (first == "sed") & (F.size(ws) >= 2) & F.array_contains(F.slice(ws, 1, 3), "-n")
    return F.coalesce(first.isin(*READ_COMMANDS) | sed, F.lit(False))


def path_args(command: Column) -> Column:
    """Path-like words of a command. -n, -c, -q and -v swallow the word after them (so ``cat -n f.py`` names none)."""
    # Left to right, so a value flag that is itself swallowed swallows nothing.
    kept = F.regexp_replace(command, r"(?<!\S)(?:" + "|".join(VALUE_FLAGS) + r")\s+\S+", " ")
    paths = F.filter(command_words(kept), lambda w: ~w.startswith("-") & likely_path(w))
    return F.transform(paths, lambda w: F.btrim(w, F.lit(_TRIM)))


def line_range(command: Column) -> Column:
    """Struct (s, e) of a reading command: head -n N is (1, N), tail -n N is (-N, -1), sed 'a,bp' is (a, b), else (1, -1)."""
    c = F.trim(command)
    first = F.lower(F.regexp_extract(c, r"^(\S+)", 1))
    n = F.regexp_extract(c, r"(?:^|\s)-n\s*(\d+)(?=\s|$)", 1).try_cast("bigint")
    a = F.regexp_extract(c, r"['\"](\d+)(?:,(\d+))?p?['\"]", 1).try_cast("bigint")
    b = F.regexp_extract(c, r"['\"](\d+)(?:,(\d+))?p?['\"]", 2).try_cast("bigint")
    pair = lambda s, e: F.struct(s.cast("bigint").alias("s"), e.cast("bigint").alias("e"))
    return (
        F.when((first == "head") & (n > 0), pair(F.lit(1), n))
        .when((first == "tail") & (n > 0), pair(-n, F.lit(-1)))
        .when((first == "sed") & a.isNotNull() & c.rlike(r"\S*['\"]\d+(?:,\d+)?p['\"]"), pair(a, F.coalesce(b, a)))
        .otherwise(pair(F.lit(1), F.lit(-1)))
    )


def segments(df: DataFrame, command: str) -> DataFrame:
    """Commands cut at &&, || and ; (not at a single pipe): adds seg_no from 0, segment, is_last."""
    parts = F.filter(F.transform(F.split(command, r"&&|\|\||;"), lambda x: F.trim(x)), lambda x: x != "")
    cut = df.withColumn("__parts", parts)
    return cut.select(*df.columns, F.posexplode("__parts").alias("seg_no", "segment"), (F.size("__parts") - 1).alias("__last")).withColumn(
        "is_last", F.col("seg_no") == F.col("__last")
    ).drop("__last")


def grep_paths(command: Column) -> Column:
    """Paths a grep names: words that are no flags and look like a path or hold a slash; none for any other command."""
    named = F.filter(command_words(command), lambda w: ~w.startswith("-") & (likely_path(w) | w.contains("/")))
    return F.when(F.lower(F.trim(command)).startswith("grep"), F.transform(named, lambda w: F.btrim(w, F.lit(_TRIM)))).otherwise(F.array().cast("array<string>"))


def logged_paths(command: Column) -> Column:
    """Paths in a logged command: words with a slash and a known suffix, quotes off, no flags and no examples; each once, sorted."""
    words = F.transform(F.filter(command_words(command), lambda w: ~w.startswith("-")), lambda w: F.btrim(w, F.lit(_TRIM)))
    suffix = "(?i)(?:" + "|".join(x.replace(".", r"\.") for x in LOGGED_SUFFIXES) + ")$"
    kept = F.filter(words, lambda w: w.contains("/") & w.rlike(suffix) & ~w.startswith(EXAMPLE_PREFIXES[0]) & ~w.startswith(EXAMPLE_PREFIXES[1]))
    return F.coalesce(F.array_sort(F.array_distinct(kept)), F.array().cast("array<string>"))


_HIT = r"^([^:]+):(\d+)[:\-]"


def grep_lines(df: DataFrame, keys: Sequence[str], output: str) -> DataFrame:
    """(path, line) of grep -n output, each once per key."""
    line = F.explode(F.split(output, r"\r?\n")).alias("l")
    return (
        df.select(*keys, line)
        .filter(F.col("l").rlike(_HIT))
        .select(*keys, F.regexp_extract("l", _HIT, 1).alias("path"), F.regexp_extract("l", _HIT, 2).cast("bigint").alias("line"))
        .distinct()
    )


def read_regions(commands: DataFrame, keys: Sequence[str], command: str, output: str | None = None) -> DataFrame:
    """Regions that commands read: keys, path, s, e. The output, if given, belongs to a command's last segment.

    Reading commands give their paths with the line range. A grep or rg gives the lines of its
    output, each once; without any, a grep gives the paths it names as whole files, and rg nothing.
    All is worked out within the row of a command, nothing is shuffled.
    """
    keys = list(keys)
    seg = segments(commands.select(*keys, command, *([output] if output else [])), command)
    one = F.col("segment")
    region = lambda path, s, e: F.struct(path.alias("path"), s.cast("bigint").alias("s"), e.cast("bigint").alias("e"))
    ranged = F.transform(path_args(one), lambda p: region(p, line_range(one)["s"], line_range(one)["e"]))
    named = F.transform(grep_paths(one), lambda p: region(p, F.lit(1), F.lit(-1)))
    searching = one.rlike(r"(?i)^(?:grep|rg )")
    if output is not None:
        lines = F.filter(F.split(F.when(F.col("is_last"), F.col(output)), r"\r?\n"), lambda x: x.rlike(_HIT))
        at = lambda x: F.regexp_extract(x, _HIT, 2).cast("bigint")
        hits = F.array_distinct(F.transform(lines, lambda x: region(F.trim(F.regexp_extract(x, _HIT, 1)), at(x), at(x))))
        named = F.when(F.size(hits) > 0, hits).otherwise(named)
    found = F.when(reads_content(one), ranged).when(searching, named)
    return seg.select(*keys, F.explode(found).alias("r")).select(*keys, "r.path", "r.s", "r.e")


def reads_by_step(messages: DataFrame, key: str = "traj_id", order: str = "step_idx") -> DataFrame:
    """Regions that a trajectory read, with the step of the reading message: key, order, path, s, e.

    messages: key, order, role, content, tool_calls. An assistant's bash block and its calls of a
    shell tool are read as commands, whose output is the content of the next message of any role;
    view calls of the editor tool name their region. Roles count after the next message is known.
    """
    keys = [key, order]
    said = with_next_content(messages, key, order).filter("role = 'assistant'")
    calls = said.select(*keys, "next_content", F.explode("tool_calls").alias("c")).select(
        *keys, "next_content", F.col("c.function.name").alias("name"), F.col("c.function.arguments").alias("arguments")
    )
    typed = F.try_variant_get(F.try_parse_json(F.col("arguments")), "$.command", "string")
    shell = calls.filter(F.col("name").isin("execute_bash", "bash")).select(*keys, "next_content", typed.alias("command"))
    blocks = said.select(*keys, "next_content", bash_block(F.col("content")).alias("command"))
    commands = blocks.unionByName(shell).filter("command is not null")
    return read_regions(commands, keys, "command", "next_content").unionByName(tool_reads(calls, keys))


def logged_commands(messages: DataFrame, key: str = "traj_id", order: str = "step_idx", tokens: str | None = None) -> DataFrame:
    """Bash blocks of assistant messages: key, command_no (from 0, counting only messages with a block), command, and the tokens of the message."""
    more = [F.coalesce(tokens, F.lit(0)).alias("tokens")] if tokens else []
    said = messages.filter("role = 'assistant'").select(key, order, bash_block(F.col("content")).alias("command"), *more).filter("command is not null")
    numbered = running_totals(said, [key], [order], {"n": F.lit(1)})
    return numbered.select(key, (F.col("n") - 1).alias("command_no"), "command", *(["tokens"] if tokens else []))


def tool_reads(calls: DataFrame, keys: Sequence[str], name: str = "name", arguments: str = "arguments") -> DataFrame:
    """Regions of view calls of an editor tool: keys, path, s, e; without a range the whole file."""
    args = F.try_parse_json(F.col(arguments))
    get = lambda p, t: F.try_variant_get(args, p, t)
    views = calls.filter((F.col(name) == "str_replace_editor") & (get("$.command", "string") == "view") & (F.coalesce(get("$.path", "string"), F.lit("")) != ""))
    ranged = get("$.view_range[1]", "bigint").isNotNull()
    return views.select(
        *keys, get("$.path", "string").alias("path"),
        F.when(ranged, get("$.view_range[0]", "bigint")).otherwise(1).alias("s"), F.when(ranged, get("$.view_range[1]", "bigint")).otherwise(-1).alias("e"),
    )


def tool_edits(calls: DataFrame, keys: Sequence[str], name: str = "name", arguments: str = "arguments") -> DataFrame:
    args = F.try_parse_json(F.col(arguments))
    path = F.try_variant_get(args, "$.path", "string")
    edit = (F.col(name) == "str_replace_editor") & (F.try_variant_get(args, "$.command", "string") == "str_replace") & (F.coalesce(path, F.lit("")) != "")
    return calls.filter(edit).select(*keys, path.alias("path")).distinct()


def with_next_content(messages: DataFrame, key: str = "traj_id", order: str = "step_idx") -> DataFrame:
    """Adds next_content, that of the next message of any role; filter by role only afterwards."""
    return messages.withColumn("next_content", F.lead("content").over(Window.partitionBy(key).orderBy(order)))


def diff_files(df: DataFrame, keys: Sequence[str], patch: str) -> DataFrame:
    """Files that a diff names, each once."""
    heads = F.regexp_extract_all(F.col(patch), F.lit(r"(?m)^diff --git a/(.+?) b/"), F.lit(1))
    news = F.regexp_extract_all(F.col(patch), F.lit(r"(?m)^\+\+\+ b/(.+?)$"), F.lit(1))
    return df.filter(F.col(patch).isNotNull()).select(*keys, F.explode(F.array_union(heads, news)).alias("path")).distinct()


def repo_root(paths: DataFrame, key: str, order: Sequence[str], path: str = "path") -> DataFrame:
    """Per key the first /workspace/<x> in order."""
    root = F.regexp_extract(path, r"^(/workspace/[^/]+)", 1)
    return paths.filter(root != "").groupBy(key).agg(F.min_by(root, F.struct(*order)).alias("root"))


def relative_path(path: Column, root: Column) -> Column:
    """Repository-relative path: wrappers, the root (as a plain prefix), /workspace/<x>/, leading slashes and ./ go."""
    p = F.regexp_replace(F.regexp_replace(path, r"^open\('", ""), r"'\)$", "")
    p = F.rtrim(F.regexp_replace(F.regexp_replace(p, "^`", ""), "`$", ""), F.lit("\")'`,"))
    clean = lambda x: F.regexp_replace(F.ltrim(x, F.lit("/")), r"^\./", "")
    under = (root != "") & p.startswith(root)
    return (
        F.when(under, clean(F.substr(p, F.length(root) + 1)))
        .when(p.rlike("^/workspace/[^/]*/"), F.regexp_replace(p, "^/workspace/[^/]*/", ""))
        .when(p.startswith("/workspace/"), "")
        .otherwise(clean(p))
    )


def temp_file(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return name.rlike("^(" + "|".join(TEMP_PREFIXES) + ")")


def plausible_path(path: Column) -> Column:
    """A path that can lie in a repository: no address, no special characters, no temporary file."""
    first = F.substring_index(path, "/", 1)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    temp = "^(" + "|".join(TEMP_BEGINNINGS) + ")"
    return (path != "") & ~path.contains("http") & ~path.rlike(r"[\")'`\]\[,<>?*|&^%$#@!~\\{};]") & ~first.rlike(temp) & ~name.rlike(temp)


def file_operations(commands: DataFrame, keys: Sequence[str], command: str) -> DataFrame:
    """Files that logged commands edit: paths of editing commands and targets of > and >>: keys, path."""
    c = F.col(command)
    ws = command_words(F.lower(c))
    first = F.get(ws, 0)
    editing = first.isin("vim", "nano", "vi", "emacs", "ed") | ((first == "sed") & F.array_contains(ws, "-i"))
    named = F.filter(F.transform(command_words(c), lambda w: F.btrim(w, F.lit(_TRIM))), lambda w: w.contains("/") & w.rlike(SUFFIX_PATTERN))
    targets = F.regexp_extract_all(c, F.lit(r">>?\s+([^\s&|]+)"), F.lit(1))
    both = F.array_union(F.when(F.coalesce(editing, F.lit(False)), named).otherwise(F.array().cast("array<string>")), targets)
    return commands.select(*keys, F.explode(both).alias("path")).distinct()


def range_list(text: Column) -> Column:
    """``[5-7, 19, 30-20]`` as an array of (s, e): swapped ends are put right, ends below 1 dropped."""
    parts = F.regexp_extract_all(F.regexp_extract(text, r"\[([\d\s,\-]*)\]", 1), F.lit(r"(\d+\s*-\s*\d+|\d+)"), F.lit(1))
    number = lambda x: F.btrim(x, F.lit(" \t\r\n")).try_cast("bigint")
    # Each bound is read once; what is too large for a number is taken as missing.
    bounds = F.transform(F.transform(parts, lambda x: F.split(x, "-")), lambda x: F.struct(number(F.get(x, 0)).alias("a"), number(F.get(x, 1)).alias("b")))
    ranges = F.transform(bounds, lambda x: F.struct(F.least(x["a"], x["b"]).alias("s"), F.greatest(x["a"], x["b"]).alias("e")))
    return F.filter(ranges, lambda r: r["s"] > 0)


def pytest_statuses(logs: DataFrame, keys: Sequence[str], log: str) -> DataFrame:
    """Last status of each test in a log; reruns are ignored: keys, test, status."""
    hit = r"^(\S+::\S+)\s+(PASSED|FAILED|ERROR|SKIPPED|XFAIL|XPASS)\b|^(PASSED|FAILED|ERROR|SKIPPED|XFAIL|XPASS)\s+(\S+::\S+)"
    lines = logs.select(*keys, F.posexplode(F.split(log, r"\r?\n")).alias("pos", "l")).filter(F.col("l").rlike(hit))
    both = lambda i, j: F.coalesce(F.nullif(F.regexp_extract("l", hit, i), F.lit("")), F.regexp_extract("l", hit, j))
    return lines.select(*keys, "pos", both(1, 4).alias("test"), both(2, 3).alias("status")).groupBy(*keys, "test").agg(F.max_by("status", "pos").alias("status"))


def event_answers(events: DataFrame, marker: str = "RELEVANT_FILES") -> DataFrame:
    """Per session the answer: all text from the last event that holds the marker on, else the last text."""
    texts = events.filter("event_type = 'text' and part.text is not null").select("sessionid", "event_id", "ts_ms", F.col("part.text").alias("text")).dropDuplicates(["event_id"])
    place = F.struct("ts_ms", "event_id")
    marks = texts.groupBy("sessionid").agg(F.max(F.when(F.col("text").contains(marker), place)).alias("mark"), F.max(place).alias("last"))
    tail = texts.join(marks, "sessionid").filter(place >= F.coalesce("mark", "last"))
    return tail.groupBy("sessionid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts_ms", "event_id", "text"))), lambda x: x["text"]), "\n").alias("answer"))


def event_errors(events: DataFrame, keys: Sequence[str], event: str = "event", pos: str = "pos") -> DataFrame:
    """Distinct errors of an event stream in order of their first sight: keys, error_no from 0, error as ``name: message``.

    ``event`` is a variant with an object ``error`` of name and data.message or message, as :func:`sources.readers.event_lines` gives it.
    """
    get = lambda p: F.try_variant_get(event, p, "string")
    message = F.coalesce(get("$.error.data.message"), get("$.error.message"))
    text = F.concat_ws(": ", get("$.error.name"), message)
    found = events.select(*keys, pos, text.alias("error")).filter("error <> ''").groupBy(*keys, "error").agg(F.min(pos).alias("at"))
    return found.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("at", "error")) - 1).alias("error_no"), "error")


def submitted_patch(messages: DataFrame, key: str = "traj_id") -> DataFrame:
    """Per run the last message with a diff, cut to where the diff begins."""
    has = F.col("content").contains("diff --git")
    return messages.filter(has).groupBy(key).agg(F.max_by(F.regexp_extract("content", r"(?s)(diff --git .*)", 1), "step_idx").alias("patch"))


_ENTRY = re.compile(r"^(?P<path>[^\s:]+(?: [^\s:]+)*?):\s*[Ll]?(?P<a>-?\d+)(?:\s*[-–—]\s*(?:[Ll]?(?P<b>-?\d+))?)?")
_WRAP = " \t`'\"*()[]<>,;"


def parse_locations(text: str | None, marker: str = "RELEVANT_FILES") -> list[tuple[str, int, int]]:
    """Locations of an answer, in order: entries of the block behind the marker, else of the prose.

    ``path:12``, ``path:12-20``, ``path:L12-L20`` with any dash; a path alone is the whole file
    (1, -1) inside of the block only. Ranges with a bound below 1 or the wrong way round are refused.
    """
    if not text:
        return []
    at = text.rfind(marker)
    block = at >= 0
    lines = (text[at + len(marker) :] if block else text).splitlines()
    found: list[tuple[str, int, int]] = []
    for line in lines:
        entry = re.sub(r"^\s*(?:[-*+•]|\d+[.)])\s+", "", line).strip(_WRAP + ":")
        tries = [entry] if block else [w.strip(_WRAP + ".") for w in line.split()]
        for one in tries:
            m = _ENTRY.match(one)
            if m and ("/" in m["path"] or "." in m["path"]) and "://" not in one:
                a, b = int(m["a"]), int(m["b"]) if m["b"] else int(m["a"])
                if 1 <= a <= b:
                    found.append((m["path"].strip(_WRAP).removeprefix("./"), a, b))
            elif block and one and " " not in one and "://" not in one and not m and ("/" in one or "." in one):
                found.append((one.removeprefix("./"), 1, -1))
    return found


def answer_locations(answers: DataFrame, key: str, text: str, k: int | None = None) -> DataFrame:
    """Ranked locations of answers: key, rank from 0, path, s, e; the first k if given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, n, *loc) for i, t in zip(batch[key], batch[text]) for n, loc in enumerate(parse_locations(t)[:k])]
            yield pd.DataFrame(rows, columns=[key, "rank", "path", "s", "e"])

    kind = dict(answers.dtypes)[key]
    return answers.filter(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"{key} {kind}, rank int, path string, s bigint, e bigint")


def entity_lines(source: str, name: str) -> tuple[int, int] | None:
    """Lines of a function, class or Class.method of a Python source; None if it isn't there or can't be parsed."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return None
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    scope, _, leaf = name.rpartition(".")
    for node in ast.walk(tree):
        if scope:
            if isinstance(node, ast.ClassDef) and node.name == scope.rpartition(".")[2]:
                for item in node.body:
                    if isinstance(item, kinds) and item.name == leaf:
                        return item.lineno, item.end_lineno or item.lineno
        elif isinstance(node, kinds) and node.name == leaf:
            return node.lineno, node.end_lineno or node.lineno
    return None


#: Fixed value: braces that are tried at most; a bound of the format, not of the data.
OBJECT_TRIES = 64
_BRACE = re.compile(r"\{")


def first_json_object(text: str | None, tries: int = OBJECT_TRIES) -> dict | None:
    """The first JSON object in a text; braces that begin a line are tried before those within one."""
    whole = text or ""
    places = [m.start() for m in _BRACE.finditer(whole)]
    begins = {at for at in places if whole[at - 1 : at] in ("", "\n")}
    read = json.JSONDecoder().raw_decode
    for at in sorted(places, key=lambda at: (at not in begins, at))[:tries]:
        with contextlib.suppress(ValueError, RecursionError):
            return read(whole, at)[0]  # what begins with a brace is an object
    return None


def test_list(text: str | None) -> list[str]:
    """A list of names given as JSON or as a Python literal; anything else is empty."""
    if not text:
        return []
    for read in (json.loads, ast.literal_eval):
        try:
            value = read(text)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            continue
        return [str(x) for x in value] if isinstance(value, (list, tuple)) else []
    return []


def extract_diff(text: str | None) -> str | None:
    """The diff in a reply: a fenced block with old and new file heads, else the first block or the text, from where the diff begins."""
    if not text:
        return None
    blocks = re.findall(r"```[\w-]*\n(.*?)```", text, re.DOTALL)
    body = next((b for b in blocks if "---" in b and "+++" in b), blocks[0] if blocks else text)
    m = re.search(r"^(?:diff --git |--- )", body, re.MULTILINE)
    return body[m.start() :].rstrip("\n") + "\n" if m else None


def recount_hunks(patch: str) -> str:
    """The patch with hunk heads that announce the lines their hunks really have."""
    out: list[str] = []
    head = None
    old = new = 0

    def close() -> None:
        if head is not None:
            m = re.match(r"@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@(.*)", out[head])
            if m:
                out[head] = f"@@ -{m[1]},{old} +{m[2]},{new} @@{m[3]}"

    for line in patch.split("\n"):
        if line.startswith(("@@ ", "diff --git ", "--- ")) and not (line.startswith("--- ") and head is not None and old > 0 and not line.startswith("--- a/")):
            close()
            head, old, new = (len(out), 0, 0) if line.startswith("@@ ") else (None, 0, 0)
        elif head is not None:
            old += line[:1] in ("-", " ")
            new += line[:1] in ("+", " ")
        out.append(line)
    close()
    return "\n".join(out)
