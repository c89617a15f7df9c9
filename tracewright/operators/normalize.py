"""Trajectories of several formats as one table: info columns and an array of messages.

Unified row: instance_id, repo, model, issue, answer, rounds, exit_status, submission, traj
ARRAY<STRUCT<role, content, tool_calls, name, tool_call_id>>. Arguments of tool calls stay JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.ordering import running_totals

CALLS = "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"
MESSAGE = f"struct<role:string,content:string,tool_calls:{CALLS},name:string,tool_call_id:string>"
#: Model names of the formats that carry none.
FORMAT_MODELS = {"openhands": "qwen3-coder-480b-instruct", "scaleswe": "scaleswe-deepseek-v3"}
ISSUE_TAG = ("<issue_description>", "</issue_description>")
UPLOAD_END = "</uploaded_files>"
ISSUE_CAP, USER_CAP = 4000, 20000


def org_of(instance_id: Column) -> Column:
    return F.when(instance_id.contains("__"), F.split_part(instance_id, F.lit("__"), F.lit(1))).otherwise("")


def repo_of(instance_id: Column) -> Column:
    """org/name of org__name-issue; empty for any other id."""
    rest = F.regexp_replace(F.regexp_extract(instance_id, "^.*?__(.*)$", 1), "-[^-]*$", "")
    return F.when(instance_id.contains("__"), F.concat(org_of(instance_id), F.lit("/"), rest)).otherwise("")


def repo_of_source(source: Column) -> Column:
    """user/repo of user_repo_prN: the suffix goes, the first underscore becomes a slash."""
    return F.regexp_replace(F.regexp_replace(source, r"(?i)_pr\d+$", ""), "^([^_]*)_", "$1/")


def first_user_text(traj: Column) -> Column:
    return F.get(F.filter(traj, lambda m: m["role"] == "user"), 0)["content"]


def tagged_issue(text: Column) -> Column:
    """Text between the issue tags, trimmed; empty without both."""
    return F.coalesce(F.trim(F.regexp_extract(text, r"(?s)<issue_description>(.+?)</issue_description>", 1)), F.lit(""))


def marked_issue(text: Column) -> Column:
    """Text between ISSUE: and INSTRUCTIONS:, trimmed; to the end without the latter."""
    return F.coalesce(F.trim(F.regexp_extract(text, r"(?s)ISSUE:\n?(.*?)(?:\n?INSTRUCTIONS|\z)", 1), F.lit(" \n\t\r")), F.lit(""))


def uploaded_issue(text: Column) -> Column:
    """Text behind the block of uploaded files, trimmed, at most 4,000 characters."""
    at = F.instr(text, UPLOAD_END)
    rest = F.trim(F.substr(text, at + len(UPLOAD_END)), F.lit(" \n\t\r"))
    return F.coalesce(F.left(F.when(text.contains("<uploaded_files>") & (at > 0), rest).otherwise(text), F.lit(ISSUE_CAP)), F.lit(""))


def task_issue(text: Column) -> Column:
    """Text of the pr_description tag, else the whole text, at most 20,000 characters."""
    tagged = F.trim(F.regexp_extract(text, r"(?s)<pr_description>(.*?)</pr_description>", 1), F.lit(" \n\t\r"))
    return F.coalesce(F.left(F.when(tagged != "", tagged).otherwise(text), F.lit(USER_CAP)), F.lit(""))


def message_text(content: Column) -> Column:
    """Text of a JSON content: a string as it is, the string items of a list joined by blanks, else empty."""
    v = F.try_parse_json(content)
    kind = F.schema_of_variant(v)
    items = F.filter(v.try_cast("array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    listed = F.array_join(F.transform(items, lambda x: x.cast("string")), " ")
    return F.when(content.isNull(), "").when(kind.startswith("ARRAY"), listed).when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind.isNull(), content).otherwise("")


def arguments_of(arguments: Column) -> Column:
    """Arguments of a call as a variant; what is no JSON object counts as none."""
    v = F.try_parse_json(arguments)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v).otherwise(F.parse_json(F.lit("{}")))


def rewrite_commands(content: Column) -> Column:
    """Fenced blocks become bash blocks; ``open f`` becomes cat, ``find_file`` and ``search_dir`` become grep -rn."""
    c = F.regexp_replace(content, r"(?s)```[\w-]*\n(.*?)\n?```", "```bash\n$1\n```")
    c = F.regexp_replace(c, r"(?m)^open\s+(\S+).*$", "cat $1")
    c = F.regexp_replace(c, r"(?m)^(?:find_file|search_dir)\s+(\"[^\"]*\"|\S+)\s+(\S+)\s*$", "grep -rn $1 $2")
    return F.regexp_replace(c, r"(?m)^(?:find_file|search_dir)\s+(\"[^\"]*\"|\S+)\s*$", "grep -rn $1 .")


def _message(role: Column, content: Column, calls: Column | None = None, name: Column | None = None, call_id: Column | None = None) -> Column:
    none = lambda t: F.lit(None).cast(t)
    return F.struct(
        role.cast("string").alias("role"), content.cast("string").alias("content"), (calls if calls is not None else none(CALLS)).alias("tool_calls"),
        (name if name is not None else none("string")).alias("name"), (call_id if call_id is not None else none("string")).alias("tool_call_id"),
    )


def _unified(df: DataFrame, instance_id: Column, repo: Column, model: Column, issue: Column, answer: Column, rounds: Column, exit_status: Column, traj: str = "traj") -> DataFrame:
    return df.select(
        instance_id.alias("instance_id"), repo.alias("repo"), model.alias("model"), issue.alias("issue"), F.coalesce(answer, F.lit("")).alias("answer"),
        rounds.cast("int").alias("rounds"), F.coalesce(exit_status, F.lit("")).alias("exit_status"), F.coalesce(answer, F.lit("")).alias("submission"), F.col(traj).alias("traj"),
    )


def from_openhands(rows: DataFrame) -> DataFrame:
    """Rows (instance_id, resolved, trajectory, model_patch, exit_status): resolved ones only; each role keeps its own fields; rounds counts all messages."""
    kept = lambda m: _message(
        m["role"], m["content"], F.when(m["role"] == "assistant", m["tool_calls"]), F.when(m["role"] == "tool", m["name"]), F.when(m["role"] == "tool", m["tool_call_id"])
    )
    t = rows.filter("resolved").withColumn("traj", F.transform("trajectory", kept))
    i = F.col("instance_id")
    return _unified(t, i, repo_of(i), F.lit(FORMAT_MODELS["openhands"]), tagged_issue(first_user_text(F.col("traj"))), F.col("model_patch"), F.size("traj"), F.col("exit_status"))


def from_swe_agent(rows: DataFrame) -> DataFrame:
    """Rows (instance_id, model_name, trajectory of role, text, system_prompt, generated_patch, exit_status): ai is assistant, empty messages go, rounds counts assistants."""
    role = lambda m: F.when(m["role"] == "ai", "assistant").otherwise(m["role"])
    text = lambda m: F.when(m["role"] == "system", F.coalesce(F.nullif(m["system_prompt"], F.lit("")), m["text"])).otherwise(m["text"])
    content = lambda m: F.when(m["role"] == "ai", rewrite_commands(text(m))).otherwise(text(m))
    t = rows.withColumn("raw", F.col("trajectory")).withColumn("traj", F.filter(F.transform("trajectory", lambda m: _message(role(m), content(m))), lambda m: F.coalesce(m["content"], F.lit("")) != ""))
    user = F.get(F.filter("raw", lambda m: (m["role"] == "user") & (F.coalesce(m["text"], F.lit("")) != "")), 0)["text"]
    i = F.col("instance_id")
    rounds = F.size(F.filter("traj", lambda m: m["role"] == "assistant"))
    return _unified(t, i, repo_of(i), F.coalesce("model_name", F.lit("unknown")), marked_issue(user), F.col("generated_patch"), rounds, F.col("exit_status"))


def from_scaleswe(rows: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Rows (instance_id, score, messages, patch): score at or above the threshold; role and content only."""
    t = rows.filter(F.col("score") >= threshold).withColumn("traj", F.transform("messages", lambda m: _message(m["role"], m["content"])))
    i = F.col("instance_id")
    return _unified(t, i, repo_of(i), F.lit(FORMAT_MODELS["scaleswe"]), uploaded_issue(first_user_text(F.col("traj"))), F.col("patch"), F.size("traj"), F.lit(""))


def from_distilled(rows: DataFrame, order: str) -> DataFrame:
    """Rows (data_source, messages, order column): the n-th run of a source, from the second on, has _tN behind its id."""
    n = F.row_number().over(Window.partitionBy("data_source").orderBy(order)) - 1
    t = rows.filter("data_source <> '' and messages is not null").withColumn("n", n).withColumn("traj", F.transform("messages", lambda m: _message(m["role"], m["content"])))
    i = F.concat("data_source", F.when(F.col("n") > 0, F.concat(F.lit("_t"), "n")).otherwise(""))
    return _unified(t, i, repo_of_source(F.col("data_source")), F.lit("distilled"), uploaded_issue(first_user_text(F.col("traj"))), F.lit(""), F.size("traj"), F.lit(""))


def from_coderforge(rows: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Rows (trajectory_id, reward, messages as JSON text, base_id, derived_repo, image): reward at or above the threshold."""
    t = rows.filter(F.col("reward") >= threshold).withColumn("traj", F.from_json("messages", f"array<{MESSAGE}>"))
    i = F.coalesce(F.nullif("base_id", F.lit("")), "trajectory_id")
    image = F.regexp_replace(F.substring_index("image", "/", -1), ":.*$", "")
    repo = F.coalesce(F.nullif("derived_repo", F.lit("")), image)
    user = first_user_text(F.col("traj"))
    return _unified(t, i, repo, F.lit("coderforge"), F.coalesce(F.left(user, F.lit(USER_CAP)), F.lit("")), F.lit(""), F.size("traj"), F.lit(""))


def from_native(rows: DataFrame) -> DataFrame:
    """Rows (path, info MAP, messages): the id is the parent folder, else the info's; keys of info without a column of their own go to meta."""
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    i = F.coalesce(F.nullif(folder, F.lit("")), F.col("info")["instance_id"])
    get = lambda k: F.col("info")[k]
    known = ["instance_id", "repo", "model", "issue", "answer", "exit_status", "submission"]
    t = rows.withColumn("traj", F.transform("messages", lambda m: _message(m["role"], m["content"])))
    out = t.select(
        i.alias("instance_id"), F.coalesce(get("repo"), repo_of(i)).alias("repo"), F.coalesce(get("model"), F.lit("unknown")).alias("model"),
        F.coalesce(get("issue"), task_issue(first_user_text(F.col("traj")))).alias("issue"), F.coalesce(get("answer"), F.lit("")).alias("answer"),
        F.size("traj").alias("rounds"), F.coalesce(get("exit_status"), F.lit("")).alias("exit_status"), F.coalesce(get("submission"), F.lit("")).alias("submission"),
        "traj", F.map_filter("info", lambda k, v: ~k.isin(*known)).alias("meta"),
    )
    return out


def number_runs(rows: DataFrame, keys: list[str], order: list[str], most: int | None = None) -> DataFrame:
    """Adds run, the number of the row within its key from 0; with ``most`` only the first that many."""
    if most is None:
        return running_totals(rows, keys, order, {"run": F.lit(1)}).withColumn("run", F.col("run") - 1)
    # A bounded number of rows per key is cut before the shuffle.
    return rows.withColumn("run", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("run") <= most).withColumn("run", F.col("run") - 1)


def slice_lines(lines: Column, start: Column, end: Column) -> Column:
    """Lines start to end of a file, both clamped into it; a negative start counts from the end; empty if inverted."""
    n = F.size(lines)
    clamp = lambda x: F.greatest(F.lit(1), F.least(x, n))
    s = clamp(F.when(start < 0, n + start + 1).otherwise(start)).cast("int")
    e = clamp(F.when(end == -1, n).otherwise(end)).cast("int")
    return F.when((n > 0) & (s <= e), F.array_join(F.slice(lines, s, e - s + 1), "\n")).otherwise("")


def context_regions(core: DataFrame, optional: DataFrame, mode: str) -> DataFrame:
    """Regions to show by mode: core_only, core_optional (each region once, core first) or no_context."""
    cols = ["instance_id", "path", "s", "e"]
    if mode == "no_context":
        return core.select(*cols).limit(0)
    own = core.select(*cols).distinct()
    if mode == "core_only":
        return own
    if mode != "core_optional":
        raise ValueError(f"unknown mode {mode}")
    return own.unionByName(optional.select(*cols).distinct().join(own, cols, "left_anti"))


def action_view(messages: DataFrame, most: int | None = 2000) -> DataFrame:
    """Step-numbered tool calls with the output that follows: traj_id, step_no from 1, name, arguments, output cut to ``most``; None keeps all of it."""
    w = Window.partitionBy("traj_id").orderBy("step_idx")
    nxt = messages.withColumn("next_role", F.lead("role").over(w)).withColumn("next_content", F.lead("content").over(w))
    calls = nxt.filter("role = 'assistant'").select("traj_id", "step_idx", "next_role", "next_content", F.posexplode("tool_calls").alias("pos", "c"))
    order = Window.partitionBy("traj_id").orderBy("step_idx", "pos")
    out = F.when(F.col("next_role") == "tool", F.col("next_content") if most is None else F.left("next_content", F.lit(most)))
    return calls.select("traj_id", F.row_number().over(order).alias("step_no"), F.col("c.function.name").alias("name"), F.col("c.function.arguments").alias("arguments"), out.alias("output"))


def prompt_text(issue: Column, files: Column, context: Column) -> Column:
    """Issue, file list and context as sections; empty sections are left out."""
    section = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"## {title}\n"), c))
    return F.concat_ws("\n\n", section("Issue", issue), section("Files", F.array_join(files, "\n")), section("Context", context))


def chat_text(messages: Column) -> Column:
    """Messages as one text: [System], [User] and [Assistant] blocks, other roles bare, with a blank line between."""
    role = lambda m: F.lower(m["role"])
    head = lambda m: F.when(role(m).isin("system", "user", "assistant"), F.concat(F.lit("["), F.initcap(role(m)), F.lit("]\n"))).otherwise("")
    return F.array_join(F.transform(messages, lambda m: F.concat(head(m), F.coalesce(m["content"], F.lit("")))), "\n\n")


def chat_messages(text: Column) -> Column:
    """The inverse of :func:`chat_text`: a text without any block is one user message, a blank one is none."""
    body = F.trim(text, F.lit(" \n\t\r"))
    parts = F.regexp_extract_all(body, F.lit(r"(?s)(?:^|(?<=\n))\[(System|User|Assistant)\]\n.*?(?=\n\[(?:System|User|Assistant)\]\n|\z)"), F.lit(0))
    one = lambda p: F.struct(F.lower(F.regexp_extract(p, r"^\[(\w+)\]", 1)).alias("role"), F.trim(F.regexp_replace(p, r"^\[\w+\]\n", ""), F.lit(" \n\t\r")).alias("content"))
    whole = F.array(F.struct(F.lit("user").alias("role"), body.alias("content")))
    return F.when(body == "", F.slice(whole, 1, 0)).when(F.size(parts) == 0, whole).otherwise(F.transform(parts, one))
