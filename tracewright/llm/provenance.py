"""Files nobody wrote by hand for their repository: generated, minified, vendored, data blobs."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import cut_lineage

#: A line of fewer characters, without outer blanks, is too common to tell where a file comes from.
LINE_CHARS = 12
#: Share of a file's lines that must lie in one file of another repository, and the least number of lines.
CONTAINED, LEAST_LINES = 0.7, 5

#: Folders and names that tell the class.
VENDORED_PATH = r"(?i)(^|/)(vendor|_vendor|vendored|vendors|third_party|third-party|thirdparty|3rdparty|node_modules|bower_components|oh_modules|site-packages|dist-packages|pods|jspm_packages|godeps|carthage)/"
GENERATED_PATH = r"(?i)(^|/)(gen|generated|__generated__|_generated|autogen|codegen-out)/|\.(g|gen|generated|designer|pb|freezed)\.\w+$|_pb2(_grpc)?\.pyi?$|_generated\.\w+$|\.pb\.(go|cc|h)$"
MINIFIED_PATH = r"(?i)[.-]min\.(js|css|mjs)$"
PROSE_PATH = r"(?i)\.(md|rst|txt|adoc|html?)$"

_COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*|<!--|--|;|%|\"\"\"|''')")
#: What the head of a file says of the file itself, not of others.
_GENERATED = re.compile(
    r"@generated\b"
    r"|\bdo not (?:edit|modify|change)(?: this file| it)?(?: by hand| manually)?\W*$"
    r"|\b(?:auto[- ]?generated|automatically generated|created automatically|generated automatically)\b"
    r"|^\W*(?:this|the) (?:file|module|code|source|script|class)\b.{0,20}\b(?:was|is|has been) (?:\w+ )?(?:generated|emitted|produced|created|built)\b"
    r"|^\W*(?:code|file|source|module|output) (?:generated|emitted|produced|created|built) (?:by|from|with)\b"
    r"|^\W*(?:generated|emitted|produced|built) (?:by|from|with)\b.*\b(?:edit|template|do not|schema)\b"
    r"|\bedit the (?:template|schema|source) (?:and )?not this file\b"
    r"|\b(?:manual )?changes (?:are|will be|get) (?:lost|overwritten)\b",
    re.IGNORECASE,
)
_VENDORED = re.compile(
    r"\bvendored (?:from|copy)\b|\bbundled copy of\b|\btaken over (?:unchanged )?from\b|\bcopied (?:verbatim |unchanged )?from\b.*\b(?:upstream|release|v?\d+\.\d)"
    r"|\bupstream (?:is|release|project|repository|source)\b|\bin step with upstream\b|\bredistributed (?:under|with|by)\b|\bthird[- ]party (?:code|library|module)\b",
    re.IGNORECASE,
)
#: Ruled lines and padding.
_MARKS = re.compile(r"[^\w\s]{10}")
_RULE = re.compile(r"([^\w\s])\1{9,}")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_NUMBER = re.compile(r"(?<![A-Za-z_])(?:0[xX][0-9a-fA-F]+|\d[\d_]*\.?\d*(?:[eE][+-]?\d+)?)")
_NAME = re.compile(r"[A-Za-z_]\w*")
_MIXED = re.compile(r"\w*\d\w*")
_NO_DIGITS = {ord(c): None for c in "0123456789"}
_LONG_NUMBER = re.compile(r"\d[_.eExX]")
_QUOTE = re.compile(r"[\"'`]")
#: A quoted run without blanks of this length is data, not text.
_BLOB = re.compile(r"(?<=[\"'`])[A-Za-z0-9+/=_\\-]{40,}(?=[\"'`])")
#: Lines of this length with fewer blanks than this share are machine-packed.
PACKED_CHARS, PACKED_BLANKS = 250, 0.12

FEATURES = "repo string, path string, start_line int, chars bigint, data_chars bigint, packed_chars bigint, lines bigint, alike_calls bigint, says_generated boolean, says_vendored boolean"


def composition(text: str) -> dict[str, object]:
    """Counts of one chunk by which its file is judged; they add up over the chunks of a file."""
    lines = (_RULE.sub(r"\1", text) if _MARKS.search(text) else text).splitlines()
    said = []
    for side in (lines, reversed(lines)):  # comments above and below the code
        for line in side:
            if line.strip() and not _COMMENT.match(line):
                break
            said.append(line.strip().strip("*#/-;<!> ").strip())
    data = packed = 0
    calls: list[str] = []
    code_lines = 0
    for line in lines:
        bare = line.strip()
        n = len(bare)
        if not n:
            continue
        code_lines += 1
        blobs = sum(map(len, _BLOB.findall(bare))) if n > 40 and _QUOTE.search(bare) else 0
        literal, digits = bare, 0
        if blobs * 2 < n:
            plain = n - len(bare.translate(_NO_DIGITS))
            # Plain digits that are less than a fifth of the line decide nothing below.
            if not bare.isascii() or plain and (5 * plain >= n or _LONG_NUMBER.search(bare)):
                literal = _NUMBER.sub("", bare)
                digits = n - len(literal)
        if blobs * 2 >= n:
            data += n
        elif digits * 2 >= n or (digits * 5 >= n and not _NAME.search(_STRING.sub("", literal))):
            data += n  # numbers and the punctuation between them
        elif n >= PACKED_CHARS:
            # A long list of literals keeps hardly any name; packed code keeps names between its operators.
            if digits > 0.4 * n:
                data += n
            elif bare.count(" ") < PACKED_BLANKS * n:
                packed += n
        if n < PACKED_CHARS and "(" in bare and "=" in bare:
            calls.append(bare)
    alike = 0
    if len(calls) >= 5 and len(calls) * 2 >= code_lines:  # else no table of declarations
        shapes = Counter(_NAME.sub("a", _NUMBER.sub("0", _STRING.sub("s", _MIXED.sub("a0", x, count=1)))) for x in calls)
        top, often = shapes.most_common(1)[0]
        alike = often if often >= 5 and "(" in top and "a" in top and "=" in top else 0
    return {
        "chars": sum(len(x.strip()) for x in lines),
        "data_chars": data,
        "packed_chars": packed,
        "lines": code_lines,
        "alike_calls": alike,
        "says_generated": any(_GENERATED.search(x) for x in said),
        "says_vendored": any(_VENDORED.search(x) for x in said),
    }


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in FEATURES.split(", ")]
    for batch in batches:
        rows = [composition(t) for t in batch["content"]]
        told = pd.DataFrame(rows, columns=names[3:], index=batch.index)
        yield pd.concat([batch[["repo", "path", "start_line"]], told], axis=1)[names]


def line_index(chunks: DataFrame) -> DataFrame:
    """Inverted index: (line, repo_id, file_id) for each distinct line of each file, as hashes."""
    bare = F.transform(F.split("content", r"\r\n|\n|\r"), lambda x: F.trim(x))
    told = F.transform(F.filter(bare, lambda x: F.length(x) >= LINE_CHARS), lambda x: F.xxhash64(x))
    return (
        chunks.select(
            F.xxhash64("repo").alias("repo_id"),
            F.xxhash64("repo", "path").alias("file_id"),
            F.explode(F.array_distinct(told)).alias("line"),
        )
        .distinct()
    )


def _contained(pairs: DataFrame, own: DataFrame, held: DataFrame) -> DataFrame:
    """file_id of those (file_id, other_id) pairs in which the other file holds enough lines, counted over all lines."""
    return (
        pairs.join(own.select("file_id", "line", "total"), "file_id")
        .join(held.select(F.col("file_id").alias("other_id"), "line"), ["other_id", "line"])
        .groupBy("file_id", "other_id")
        .agg((F.count("*") >= CONTAINED * F.max("total")).alias("holds"))
        .filter("holds")
        .select("file_id")
        .distinct()
    )


def _by_star(own: DataFrame, held: DataFrame, turn: int) -> DataFrame:
    """file_id of files that lie in a representative: per line, the files of the first and last repository of a random order.

    Each line names at most two files instead of all that hold it, so a library that lies in every
    repository costs no more than its lines. A file is compared, over all its lines, with the
    representative that its rare lines name most.
    """
    place = F.struct(F.xxhash64("repo_id", F.lit(turn)).alias("at"), "repo_id", F.xxhash64("file_id", F.lit(turn)).alias("then"), "file_id")
    ends = (
        held.join(own.select("line").distinct(), "line", "left_semi")
        .groupBy("line").agg(F.min(place).alias("low"), F.max(place).alias("high"))
        .select("line", "low.repo_id", F.col("low.file_id").alias("low_id"), F.col("high.file_id").alias("high_id"))
        .withColumnRenamed("repo_id", "low_repo")
    )
    met = (
        own.join(ends, "line")
        .withColumn("other_id", F.when(F.col("low_repo") == F.col("repo_id"), F.col("high_id")).otherwise(F.col("low_id")))
        .groupBy("file_id", "other_id").agg(F.sum(1 / F.col("files")).alias("votes"))
    )
    best = met.groupBy("file_id").agg(F.max_by("other_id", F.struct("votes", "other_id")).alias("other_id"))
    return _contained(best, own, held)


def _by_rare_lines(own: DataFrame, held: DataFrame) -> DataFrame:
    """file_id of files that lie in any file of another repository, by prefix filtering: nothing is missed.

    A file that holds at least ceil(CONTAINED * n) of n lines misses at most n minus that many, so it
    holds one of any n - ceil(CONTAINED * n) + 1 of them. The rarest are taken. Lines that no other
    repository holds belong to them but lead nowhere.
    """
    total = F.col("total")
    misses = total - F.ceil(CONTAINED * total) + 1
    rarest = Window.partitionBy("file_id").orderBy("files", "line")  # at most the lines of one file
    prefix = own.withColumn("at", F.row_number().over(rarest)).filter(F.col("at") <= misses - (total - F.col("shared"))).select("file_id", "repo_id", "line")
    other = held.select(F.col("repo_id").alias("other_repo"), F.col("file_id").alias("other_id"), "line")
    pairs = prefix.join(other, "line").filter("repo_id <> other_repo").select("file_id", "other_id").distinct()
    return _contained(pairs, own, held)


def foreign_copies(chunks: DataFrame) -> DataFrame:
    """file_id of every file of at least LEAST_LINES distinct lines, a share of CONTAINED of which lies in one file of another repository.

    Exact: the result is that of comparing all pairs of files. Lines are stored once, marked with
    whether a second repository holds them (a count that is combined before the shuffle). Files
    with too few such lines drop out; in files of one text that lies in several repositories
    nothing is left to compare. The others meet the representatives of their lines
    (:func:`_by_star`), again with another order while that settles a fifth of them, and what is
    still open meets every file that holds one of its rarest lines (:func:`_by_rare_lines`).
    """
    lines = line_index(chunks)
    spread = (
        lines.groupBy("line")
        .agg(F.min("repo_id").alias("least"), F.max("repo_id").alias("greatest"), F.count("*").alias("files"))
        .filter("least <> greatest")
        .select("line", "files")
    )
    marked = cut_lineage(lines.join(spread, "line", "left"))
    held = marked.filter("files is not null")
    per_file = (
        marked.groupBy("repo_id", "file_id")
        .agg(F.count("*").alias("total"), F.count("files").alias("shared"), F.bit_xor("line").alias("x"), F.bit_xor(F.xxhash64("line")).alias("y"))
        .filter((F.col("total") >= LEAST_LINES) & (F.col("shared") >= F.ceil(CONTAINED * F.col("total"))))
    )
    # Files of the same lines are one class, which is found if it lies in two repositories; else one file of it is compared.
    text = ["total", "x", "y"]
    likely = cut_lineage(per_file)
    classes = likely.groupBy(*text).agg(F.min("repo_id").alias("least"), F.max("repo_id").alias("greatest"), F.min("file_id").alias("one"))
    open_files = classes.filter("least = greatest").select(F.col("one").alias("file_id"))
    own = cut_lineage(held.join(likely.join(open_files, "file_id", "left_semi").select("file_id", "total", "shared"), "file_id"))
    found = None
    left = open_files.count()
    turn = 0
    while left:
        settled = cut_lineage(_by_star(own, held, turn))
        n = settled.count()
        found = settled if found is None else found.unionByName(settled)
        if n:
            own = own.join(settled, "file_id", "left_anti")
        if 5 * n < left:
            found = found.unionByName(_by_rare_lines(own, held))
            break
        left, turn = left - n, turn + 1
    copied = classes.filter("least <> greatest").select(*text)
    if found is not None:
        copied = copied.unionByName(classes.join(found, F.col("one") == F.col("file_id"), "left_semi").select(*text))
    return likely.join(copied, text, "left_semi").select("file_id")


def file_classes(chunks: DataFrame) -> DataFrame:
    """(repo, path, file_class) of every file that is not hand-written for its repository.

    ``vendored``: the path or the head of the file says so, or most of its lines lie in a file of
    another repository. ``generated``: path or head say so, or the file is one shape of
    declaration repeated with counting numbers. ``data_blob``: most characters are literals.
    ``minified``: most characters lie in long lines without blanks. Vendored goes before minified,
    data_blob and generated. Prose files are never generated by what they say, packed or data.
    Chunks may overlap and repeat: shares over a file hardly feel it. Null or empty content adds
    nothing, so such files are judged by their path. Rows without repo or path are left out.
    """
    known = chunks.filter("repo is not null and path is not null")
    told = known.filter("content is not null").select("repo", "path", "start_line", "content").mapInPandas(_features, FEATURES)
    names = known.select("repo", "path").distinct()
    files = told.groupBy("repo", "path").agg(
        *[F.sum(c).alias(c) for c in ("chars", "data_chars", "packed_chars", "lines", "alike_calls")],
        F.max("says_generated").alias("says_generated"),
        F.max("says_vendored").alias("says_vendored"),
    )
    copies = foreign_copies(known.filter("content is not null")).withColumn("copied", F.lit(True))
    path = F.col("path")
    code = ~path.rlike(PROSE_PATH)
    said = lambda c: F.coalesce(c, F.lit(False))
    share = lambda c, of: F.coalesce(F.try_divide(F.col(c), F.col(of)), F.lit(0.0))
    judged = (
        names.join(files, ["repo", "path"], "left")
        .withColumn("file_id", F.xxhash64("repo", "path"))
        .join(copies, "file_id", "left")
        .withColumn(
            "file_class",
            F.when(path.rlike(VENDORED_PATH) | said(F.col("says_vendored")) | said(F.col("copied")), "vendored")
            .when(path.rlike(MINIFIED_PATH) | (code & (share("packed_chars", "chars") >= 0.5)), "minified")
            .when(code & (share("data_chars", "chars") >= 0.6), "data_blob")
            .when(
                path.rlike(GENERATED_PATH)
                | (code & (said(F.col("says_generated")) | said((F.col("alike_calls") >= 20) & (share("alike_calls", "lines") >= 0.8)))),
                "generated",
            ),
        )
    )
    return judged.filter("file_class is not null").select("repo", "path", "file_class")
