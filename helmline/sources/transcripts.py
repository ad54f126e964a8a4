"""Transcript files to canonical records. One line is one JSON object; a file is one session.

Files are read by split, not whole: the place of a line is (split start, row order in the split), and
its byte offset is a running sum over the splits of its file, so a very large file is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helmline.functions import text as T
from helmline.functions.ordered import Run, running
from helmline.plans.stage import stage
from helmline.sources.linking import answers, mark_failed
from helmline.sources.records import ACTIONS, VERBS, conform, speaker_class

_NONE = "array<string>"


def read_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """Non-blank lines: path, pos (1-based ordinal), offset (bytes), line, record_sha256."""
    raw = (
        spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).text(path)
        .select(F.col("_metadata.file_path").alias("path"),
                F.col("_metadata.file_block_start").alias("split"),
                F.monotonically_increasing_id().alias("row"), "value")
    )
    blank = F.col("value").rlike(r"\A\s*\z")
    d = running(
        stage(raw, "lines"), ["path"], ["split", "row"], F.col("split"), {
            "offset": Run("sum", F.octet_length("value").cast("long") + 1, strict=True),
            "pos": Run("sum", (~blank).cast("long")),
        }, reread=True)
    line = F.regexp_replace("value", r"\r+\z", "")
    return d.where(~blank).select(
        "path", "pos", "offset", line.alias("line"), F.sha2(line, 256).alias("record_sha256"))


def parse(lines: DataFrame, schema: str, adapter: str, strict: bool = True) -> DataFrame:
    """JSON objects as struct `r`. Strict: a line that does not parse fails the read with its offset."""
    r = F.from_json("line", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    d = lines.withColumn("r", r)
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    if not strict:
        return d.where(~bad)
    fail = F.raise_error(F.concat(F.lit(f"{adapter}: cannot decode the record at offset "),
                                  F.col("offset").cast("string"), F.lit(" of "), F.col("path")))
    return d.withColumn("r", F.when(bad, fail.cast(d.schema["r"].dataType)).otherwise(F.col("r")))


def timestamp(s: Column) -> Column:
    """RFC 3339 with a zone; anything else is missing, not an error."""
    ok = s.rlike(r"\A\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)\z")
    return F.when(ok, F.try_to_timestamp(s))


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*\z", "")


def _source(adapter):
    return F.struct(F.lit(adapter).alias("adapter"), "path", "offset", "record_sha256")


def _first(d: DataFrame, value: Column, name: str) -> DataFrame:
    """First non-empty value of each file, by line order."""
    v = F.nullif(value, F.lit(""))
    got = d.groupBy("path").agg(F.min_by(v, F.when(v.isNotNull(), F.col("pos"))).alias(name))
    return d.join(got, "path")


def _finish(d: DataFrame, adapter: str, session: Column, turn: Column) -> DataFrame:
    """Stream id of the file, ordinal, provenance and promoted columns."""
    d = _first(d.withColumn("__session", session), F.col("__session"), "__stream")
    seq = F.col("pos").cast("long")
    return conform(d.select(
        F.coalesce("__stream", _stem(F.col("path"))).alias("stream_id"),
        F.coalesce(F.nullif(turn, F.lit("")), F.concat(F.lit("seq-"), seq.cast("string"))).alias("turn_id"),
        seq.alias("seq"), "ts", "speaker", "speaker_class", F.coalesce("text", F.lit("")).alias("text"),
        "actions", "reply_to", _source(adapter).alias("source"), "metadata", "sidechain", "input_mode"))


def _meta(*pairs) -> Column:
    """String map without the keys whose value is missing."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull() & (e["value"] != "")))


def _action(verb, targets, argv, failed) -> Column:
    return F.struct(verb.alias("verb"), targets.alias("targets"), argv.alias("argv"), failed.alias("failed"))


def _targets(root, *paths) -> Column:
    named = F.array(*[T.normalize_target(root, F.coalesce(p, F.lit(""))) for p in paths])
    return F.filter(named, lambda t: t != "")


def _verb(name: Column, table: dict) -> Column:
    out = F.when(F.lit(False), "")
    for verb, names in table.items():
        out = out.when(name.isin(*names), verb)
    return out.otherwise("unknown")


# ---- neutral format -----------------------------------------------------------------------------
def read_generic(spark: SparkSession, path: str) -> DataFrame:
    return decode_generic(read_lines(spark, path))


def decode_generic(lines: DataFrame) -> DataFrame:
    """Lines of the neutral format to records."""
    d = parse(lines, (
        "stream_id string, turn_id string, seq bigint, timestamp string, speaker string, text string, "
        "reply_to string, sidechain boolean, root string, "
        f"actions {ACTIONS}"), "generic")
    r = F.col("r")
    root = F.coalesce(r["root"], F.lit(""))
    acts = F.transform(r["actions"], lambda a: _action(
        F.when(a["verb"].isin(*VERBS), a["verb"]).otherwise("unknown"),
        F.filter(F.transform(F.coalesce(a["targets"], F.array().cast(_NONE)),
                             lambda t: T.normalize_target(root, t)), lambda t: t != ""),
        F.coalesce(a["argv"], F.array().cast(_NONE)), F.coalesce(a["failed"], F.lit(False))))
    d = d.select(
        "path", "pos", "offset", "record_sha256", r["stream_id"].alias("sid"), r["turn_id"].alias("tid"),
        timestamp(r["timestamp"]).alias("ts"), F.coalesce(r["speaker"], F.lit("")).alias("speaker"),
        r["text"].alias("text"), acts.alias("actions"), r["reply_to"].alias("reply_to"),
        F.coalesce(r["sidechain"], F.lit(False)).alias("sidechain"), F.lit("").alias("input_mode"),
        _meta(("source_seq", F.nullif(r["seq"], F.lit(0))),
              ("sidechain", F.when(r["sidechain"], "true"))).alias("metadata"))
    d = d.withColumn("speaker_class", speaker_class(F.col("speaker")))
    return _finish(d, "generic", F.col("sid"), F.col("tid"))


# ---- block format -------------------------------------------------------------------------------
# Tool names by verb, wrapper tags by input mode, record types that are not turns.
BLOCK_TOOLS = {
    "read": ("Read", "WebFetch"), "write": ("Edit", "Write", "NotebookEdit"), "execute": ("Bash",),
    "search": ("Grep", "Glob", "WebSearch"), "ask": ("AskUserQuestion",),
}
WRAPPERS = (
    ("bash-input", "shell_escape"), ("bash-stdout", "command_output"), ("bash-stderr", "command_output"),
    ("local-command-stdout", "command_output"), ("local-command-stderr", "command_output"),
    ("command-name", "cli_command"), ("task-notification", "command_output"),
)
INTERRUPT = "[Request interrupted by user"
NON_TURNS = ("summary", "attachment", "mode", "ai-title", "agent-name", "last-prompt", "permission-mode",
             "queue-operation", "file-history-snapshot", "file-history-delta", "pr-link", "frame-link")

_BLOCKS = ("array<struct<type:string,text:string,name:string,id:string,tool_use_id:string,content:variant,"
           "input:struct<file_path:string,notebook_path:string,path:string,command:string>,is_error:boolean>>")


def _is_string(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def _nested_text(v: Column) -> Column:
    blocks = F.from_json(v.cast("string"), "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & (b["text"] != "")),
                        lambda b: b["text"])
    return F.coalesce(F.array_join(texts, "\n"), F.lit(""))


def read_claude(spark: SparkSession, path: str) -> DataFrame:
    return decode_claude(read_lines(spark, path))


def decode_claude(lines: DataFrame) -> DataFrame:
    """Lines of the block format to records."""
    d = parse(lines, (
        "type string, subtype string, uuid string, parentUuid string, sessionId string, cwd string, "
        "timestamp string, isSidechain boolean, isMeta boolean, message struct<role:string,content:variant>, "
        "content variant, toolUseResult variant, summary string, aiTitle string, isCompactSummary boolean, "
        "attachment struct<type:string,prompt:variant,commandMode:string,origin:struct<kind:string>>"),
        "claude-code")
    r = F.col("r")
    content = r["message"]["content"]
    plain = _is_string(content)
    blocks = F.when(~plain, F.from_json(content.cast("string"), _BLOCKS))
    d = _first(d, r["cwd"], "root").withColumn("blocks", F.coalesce(blocks, F.array().cast(_BLOCKS)))
    d = stage(d.withColumn("plain", F.when(plain, content.cast("string"))), "blocks")
    b, r = F.col("blocks"), F.col("r")

    def part(x):
        result = F.when(_is_string(x["content"]), x["content"].cast("string")).otherwise(
            F.nullif(_nested_text(x["content"]), F.lit("")))
        return F.when(x["type"] == "text", F.nullif(x["text"], F.lit(""))).when(
            x["type"] == "tool_result", result)

    text = F.coalesce("plain", F.array_join(F.transform(b, part), "\n"))
    tools = F.size(F.filter(b, lambda x: x["type"] == "tool_result"))
    has_text = F.when(F.col("plain").isNotNull(), T.trim(F.col("plain")) != "").otherwise(
        F.exists(b, lambda x: (x["type"] == "text") & (F.coalesce(x["text"], F.lit("")) != "")))
    used = F.filter(b, lambda x: (x["type"] == "tool_use") & (F.coalesce(x["name"], F.lit("")) != ""))
    assistant = r["type"] == "assistant"

    calls = d.where(assistant).select("path", "pos", F.explode(used).alias("x")).select(
        "path", "pos", F.col("x.id").alias("call_id"), F.col("x.name").alias("tool")).where("call_id <> ''")
    results = d.select("path", "pos", F.explode(F.filter(b, lambda x: x["type"] == "tool_result")).alias("x"),
                       r["toolUseResult"].alias("tur")).select(
        "path", "pos", F.col("x.tool_use_id").alias("call_id"),
        F.coalesce("x.is_error", F.lit(False)).alias("is_error"), "tur")
    failed = mark_failed(calls, results.drop("tur")).where("failed").groupBy("path", "pos").agg(
        F.collect_set("call_id").alias("failed_ids"))
    tur = F.from_json(F.col("tur").cast("string"),
                      "answers map<string,string>, annotations map<string,struct<notes:string>>")
    said = results.select("path", "pos", "call_id", tur.alias("t")).select(
        "path", "pos", "call_id", F.col("t.answers").alias("answers"),
        F.transform(F.map_values("t.annotations"), lambda n: F.coalesce(n["notes"], F.lit(""))).alias("notes"))
    said = answers(said, calls, "AskUserQuestion").groupBy("path", "pos").agg(
        F.min("text").alias("answer"))
    d = d.join(failed, ["path", "pos"], "left").join(said, ["path", "pos"], "left")

    acts = F.when(assistant, F.transform(used, lambda x: _action(
        _verb(x["name"], BLOCK_TOOLS),
        _targets(F.coalesce("root", F.lit("")), x["input"]["file_path"], x["input"]["notebook_path"],
                 x["input"]["path"]),
        F.array_compact(F.array(F.nullif(x["input"]["command"], F.lit("")))),
        F.coalesce(F.array_contains(F.col("failed_ids"), x["id"]), F.lit(False)))))
    d = d.withColumns({"text0": text, "body": T.trim(text), "tools": tools, "has_text": has_text})
    wrap = F.when(F.col("body").startswith(INTERRUPT), "interrupt")
    inner = F.lit(None).cast("string")
    for tag, mode in WRAPPERS:
        hit = F.col("body").startswith(f"<{tag}>")
        wrap = wrap.when(hit, mode)
        rest = F.substr(F.col("body"), F.lit(len(tag) + 3))
        inner = F.coalesce(inner, F.when(hit, F.substring_index(rest, f"</{tag}>", 1)))
    user = r["type"] == "user"
    queued = (r["type"] == "attachment") & (r["attachment"]["type"] == "queued_command") & (
        r["attachment"]["origin"]["kind"] == "human")
    prompt = r["attachment"]["prompt"]
    plumbing = r["toolUseResult"].isNotNull() | (~F.col("has_text") & (F.col("tools") > 0))
    no = F.lit(False)

    def rule(cond, speaker, cls, mode, txt):
        return cond, F.struct(speaker.alias("speaker"), F.lit(cls).alias("cls"), F.lit(mode).alias("mode"),
                              txt.alias("text"))

    s, u, tl = F.lit("system"), F.lit("user"), F.lit("tool")
    empty, t0 = F.lit(""), F.col("text0")
    rules = [
        rule(user & F.coalesce(r["isMeta"], no), s, "system", "", t0),
        rule(user & F.coalesce(r["isCompactSummary"], no), s, "system", "compact_summary", t0),
        rule(user & F.col("answer").isNotNull(), u, "human", "structured_answer", F.col("answer")),
        rule(user & plumbing, tl, "tool", "", t0),
        rule(user & (wrap == "shell_escape"), u, "human", "shell_escape", inner),
        rule(user & (wrap == "cli_command"), u, "human", "cli_command", inner),
        rule(user & (wrap == "command_output"), tl, "tool", "", inner),
        rule(user & (wrap == "interrupt"), s, "system", "interrupt", t0),
        rule(user, u, "human", "typed", t0),
        rule(assistant, F.lit("assistant"), "agent", "", t0),
        rule(r["type"] == "system", s, "system", "",
             F.when(_is_string(r["content"]), r["content"].cast("string")).otherwise("")),
        rule(queued & (r["attachment"]["commandMode"] == "prompt"), u, "human", "typed",
             F.when(_is_string(prompt), prompt.cast("string")).otherwise(_nested_text(prompt))),
        rule(queued, u, "human", "cli_command",
             F.when(_is_string(prompt), prompt.cast("string")).otherwise(_nested_text(prompt))),
        rule(r["type"].isin(*NON_TURNS), s, "system", "",
             F.when(r["type"] == "summary", r["summary"]).otherwise("")),
    ]
    who = F.when(no, rules[0][1])
    for cond, out in rules:
        who = who.when(F.coalesce(cond, no), out)
    who = who.otherwise(rule(no, F.coalesce(r["type"], empty), "unknown", "", empty)[1])
    d = d.withColumn("who", who).select(
        "path", "pos", "offset", "record_sha256", r["sessionId"].alias("sid"), r["uuid"].alias("tid"),
        timestamp(r["timestamp"]).alias("ts"), F.col("who.speaker").alias("speaker"),
        F.col("who.cls").alias("speaker_class"), F.col("who.text").alias("text"), acts.alias("actions"),
        r["parentUuid"].alias("reply_to"), F.coalesce(r["isSidechain"], no).alias("sidechain"),
        F.col("who.mode").alias("input_mode"),
        _meta(("record_type", r["type"]), ("record_subtype", r["subtype"]),
              ("sidechain", F.when(r["isSidechain"], "true")), ("input_mode", F.col("who.mode")),
              ("tool_name", F.when(assistant, F.array_join(F.transform(used, lambda x: x["name"]), ","))),
              ("stream_name", F.when(r["type"].isin(*NON_TURNS), r["aiTitle"]))).alias("metadata"))
    return _finish(d, "claude-code", F.col("sid"), F.col("tid"))


# ---- part format --------------------------------------------------------------------------------
# Tool names by verb.
PART_TOOLS = {
    "read": ("read_file", "list_directory", "web_fetch"), "write": ("write_file", "edit"),
    "execute": ("run_shell_command",), "search": ("grep_search", "glob"), "ask": ("ask_user_question",),
}


def read_qwen(spark: SparkSession, path: str) -> DataFrame:
    return decode_qwen(read_lines(spark, path))


def decode_qwen(lines: DataFrame) -> DataFrame:
    """Lines of the part format to records."""
    d = parse(lines, (
        "type string, subtype string, uuid string, parentUuid string, sessionId string, cwd string, "
        "timestamp string, provenance string, isSidechain boolean, "
        "message struct<role:string,parts:array<struct<text:string,thought:boolean,"
        "functionCall:struct<id:string,name:string,args:struct<file_path:string,path:string,url:string,command:string>>,"
        "functionResponse:struct<id:string,name:string,response:struct<output:string,error:string>>>>>, "
        "systemPayload struct<phase:string,rawCommand:string>"), "qwen")
    d = _first(d, F.col("r.cwd"), "root")
    r, no, empty = F.col("r"), F.lit(False), F.lit("")
    parts = F.coalesce(r["message"]["parts"], F.array().cast(
        d.schema["r"].dataType["message"].dataType["parts"].dataType))
    d = d.withColumn("parts", parts)
    p = F.col("parts")
    full = lambda c: F.coalesce(c, empty) != ""
    text = F.array_join(F.transform(F.filter(p, lambda x: ~F.coalesce(x["thought"], no) & full(x["text"])),
                                    lambda x: x["text"]), "\n")
    reply = lambda x: F.coalesce(F.nullif(x["functionResponse"]["response"]["output"], empty),
                                 F.nullif(x["functionResponse"]["response"]["error"], empty))
    result = F.array_join(F.transform(p, reply), "\n")
    used = F.filter(p, lambda x: full(x["functionCall"]["name"]))
    assistant = r["type"] == "assistant"
    calls = d.where(assistant).select("path", "pos", F.explode(used).alias("x")).select(
        "path", "pos", F.col("x.functionCall.id").alias("call_id")).where("call_id <> ''")
    results = d.select("path", "pos", F.explode(p).alias("x")).select(
        "path", "pos", F.col("x.functionResponse.id").alias("call_id"),
        full(F.col("x.functionResponse.response.error")).alias("is_error")).where("call_id <> ''")
    failed = mark_failed(calls, results).where("failed").groupBy("path", "pos").agg(
        F.collect_set("call_id").alias("failed_ids"))
    d = d.join(failed, ["path", "pos"], "left")
    acts = F.when(assistant, F.transform(used, lambda x: _action(
        _verb(x["functionCall"]["name"], PART_TOOLS),
        _targets(F.coalesce("root", empty), x["functionCall"]["args"]["file_path"],
                 x["functionCall"]["args"]["path"], x["functionCall"]["args"]["url"]),
        F.array_compact(F.array(F.nullif(x["functionCall"]["args"]["command"], empty))),
        F.coalesce(F.array_contains(F.col("failed_ids"), x["functionCall"]["id"]), no))))
    slash = (r["type"] == "system") & (r["subtype"] == "slash_command") & (
        r["systemPayload"]["phase"] == "invocation") & full(r["systemPayload"]["rawCommand"])
    out = lambda sp, cls, mode, tx: F.struct(
        sp.alias("speaker"), F.lit(cls).alias("cls"), F.lit(mode).alias("mode"), tx.alias("text"))
    who = (
        F.when(F.coalesce(slash, no), out(F.lit("user"), "human", "cli_command", r["systemPayload"]["rawCommand"]))
        .when(r["type"] == "system", out(F.lit("system"), "system", "", empty))
        .when((r["type"] == "user") & F.coalesce(r["provenance"] == "real_user", no),
              out(F.lit("user"), "human", "typed", text))
        .when(r["type"] == "user", out(F.lit("system"), "system", "", text))
        .when(assistant, out(F.lit("assistant"), "agent", "", text))
        .when(r["type"] == "tool_result", out(F.lit("tool"), "tool", "", result))
        .otherwise(out(F.coalesce(r["type"], empty), "unknown", "", empty)))
    d = d.withColumn("who", who).select(
        "path", "pos", "offset", "record_sha256", r["sessionId"].alias("sid"), r["uuid"].alias("tid"),
        timestamp(r["timestamp"]).alias("ts"), F.col("who.speaker").alias("speaker"),
        F.col("who.cls").alias("speaker_class"), F.col("who.text").alias("text"), acts.alias("actions"),
        r["parentUuid"].alias("reply_to"), F.coalesce(r["isSidechain"], no).alias("sidechain"),
        F.col("who.mode").alias("input_mode"),
        _meta(("record_type", r["type"]), ("record_subtype", r["subtype"]),
              ("sidechain", F.when(r["isSidechain"], "true")), ("input_mode", F.col("who.mode")),
              ("tool_name", F.when(assistant, F.array_join(
                  F.transform(used, lambda x: x["functionCall"]["name"]), ",")))).alias("metadata"))
    return _finish(d, "qwen", F.col("sid"), F.col("tid"))


# ---- rollout format -----------------------------------------------------------------------------
def read_codex(spark: SparkSession, path: str) -> DataFrame:
    return decode_codex(read_lines(spark, path))


def decode_codex(lines: DataFrame) -> DataFrame:
    """Only the event lane becomes records; lines that do not parse are left out."""
    item = ("struct<type:string,id:string,content:array<struct<type:string,text:string>>,command:array<string>,"
            "status:string,exit_code:int,changes:map<string,struct<type:string>>>")
    d = parse(lines, (
        "timestamp string, type string, payload struct<type:string,message:string,turn_id:string,reason:string,"
        "changes:map<string,struct<type:string>>,success:boolean,status:string,cwd:string,id:string,"
        f"item:{item}>"), "codex", strict=False)
    r, no, empty = F.col("r"), F.lit(False), F.lit("")
    d = _first(d, F.when(r["type"] == "session_meta", r["payload"]["cwd"]), "root")
    d = _first(d, F.when(r["type"] == "session_meta", r["payload"]["id"]), "sid")
    e, it = r["payload"], r["payload"]["item"]
    kind, item_kind = e["type"], F.lower(it["type"])
    text = F.array_join(F.transform(F.filter(it["content"], lambda x: (F.lower(x["type"]) == "text") & (x["text"] != "")),
                                    lambda x: x["text"]), "\n")
    root = F.coalesce("root", empty)

    def wrote(changes, failed):
        paths = F.transform(F.array_sort(F.map_keys(changes)), lambda x: T.normalize_target(
            root, F.regexp_replace(x, r"\Afile://", "")))
        return F.array(_action(F.lit("write"), F.filter(paths, lambda t: t != ""), F.array().cast(_NONE), failed))

    ran = F.array(_action(F.lit("execute"), F.array().cast(_NONE), F.coalesce(it["command"], F.array().cast(_NONE)),
                          F.coalesce(it["status"] == "failed", no) | F.coalesce(it["exit_code"] != 0, no)))
    out = lambda sp, cls, mode, tx, ac=F.lit(None).cast(ACTIONS): F.struct(
        F.lit(sp).alias("speaker"), F.lit(cls).alias("cls"), F.lit(mode).alias("mode"), tx.alias("text"), ac.alias("acts"))
    said = lambda c: T.trim(F.coalesce(c, empty)) != ""
    item_done = (kind == "item_completed") & it.isNotNull()
    who = (
        F.when((kind == "user_message") & said(e["message"]), out("user", "human", "typed", e["message"]))
        .when((kind == "agent_message") & said(e["message"]), out("assistant", "agent", "", e["message"]))
        .when(kind == "patch_apply_end", out("assistant", "agent", "", empty, wrote(
            e["changes"], F.coalesce(~e["success"], no) | F.coalesce(e["status"] == "failed", no))))
        .when(kind == "turn_aborted", out("system", "system", "interrupt",
                                          F.concat(F.lit("turn aborted: "), F.coalesce(e["reason"], empty))))
        .when(item_done & (item_kind == "usermessage") & said(text), out("user", "human", "typed", text))
        .when(item_done & (item_kind == "agentmessage"), out("assistant", "agent", "", F.coalesce(text, empty)))
        .when(item_done & (item_kind == "commandexecution"), out("assistant", "agent", "", empty, ran))
        .when(item_done & (item_kind == "filechange"), out("assistant", "agent", "", empty, wrote(
            it["changes"], F.coalesce(it["status"] == "failed", no)))))
    d = d.where(r["type"] == "event_msg").withColumn("who", who).where("who is not null")
    empty_write = F.exists(F.coalesce(F.col("who.acts"), F.array().cast(ACTIONS)),
                           lambda a: (a["verb"] == "write") & (F.size(a["targets"]) == 0))
    d = d.where(~empty_write).withColumnRenamed("pos", "line_no")
    d = running(d, ["path"], ["line_no"], F.floor(F.col("line_no") / 65536), {
        "pos": Run("sum", F.lit(1).cast("long"))})
    tid = F.when(item_done, F.coalesce(F.nullif(it["id"], empty), e["turn_id"])).otherwise(e["turn_id"])
    d = d.select(
        "path", "pos", "offset", "record_sha256", "sid", tid.alias("tid"), timestamp(r["timestamp"]).alias("ts"),
        F.col("who.speaker").alias("speaker"), F.col("who.cls").alias("speaker_class"),
        F.col("who.text").alias("text"), F.col("who.acts").alias("actions"),
        F.lit(None).cast("string").alias("reply_to"), no.alias("sidechain"), F.col("who.mode").alias("input_mode"),
        _meta(("record_type", F.when(item_done, F.concat(F.lit("item:"), it["type"])).otherwise(kind)),
              ("input_mode", F.col("who.mode"))).alias("metadata"))
    return _finish(d, "codex", F.col("sid"), F.col("tid"))


# ---- store-backed format ------------------------------------------------------------------------
# Tool names by verb.
STORE_TOOLS = {
    "read": ("read", "webfetch", "list"), "write": ("write", "edit", "patch"), "execute": ("bash",),
    "search": ("grep", "glob", "websearch"), "ask": ("question",),
}


def read_opencode(session: DataFrame, message: DataFrame, part: DataFrame) -> DataFrame:
    """Exported tables: session(id, directory), message(id, session_id, time_created, data),
    part([id,] message_id, session_id, time_created, data). One record per message that says or does something.

    Parts of equal time are ordered by their id, or by their data where ids weren't exported. A session that wasn't exported
    has no directory; its messages are kept.
    """
    empty, no = F.lit(""), F.lit(False)
    p = F.from_json("data", "type string, text string, synthetic boolean, tool string, state struct<status:string,"
                    "input:struct<filePath:string,path:string,command:string>,metadata:struct<exit:int>>")
    parts = part.withColumn("p", p).join(
        session.select(F.col("id").alias("session_id"), F.coalesce("directory", empty).alias("root")), "session_id", "left").withColumn("root", F.coalesce("root", empty))
    tie = F.col("id" if "id" in part.columns else "data")
    x = F.col("p")
    text = F.when((x["type"] == "text") & ~F.coalesce(x["synthetic"], no) & (T.trim(F.coalesce(x["text"], empty)) != ""),
                  x["text"])
    exit_bad = F.coalesce(x["state"]["metadata"]["exit"] != 0, no)
    act = F.when((x["type"] == "tool") & ~F.coalesce(x["tool"], empty).isin("", "invalid"), _action(
        _verb(x["tool"], STORE_TOOLS),
        _targets(F.col("root"), x["state"]["input"]["filePath"], x["state"]["input"]["path"]),
        F.array_compact(F.array(F.nullif(x["state"]["input"]["command"], empty))),
        F.coalesce(x["state"]["status"] == "error", no) | exit_bad))
    # Parts of one message are a message.
    body = parts.select("message_id", "time_created", tie.alias("i"),
                        text.alias("t"), act.alias("a")).where("t is not null or a is not null").groupBy(
        "message_id").agg(F.array_sort(F.collect_list(F.struct("time_created", "i", "t", "a"))).alias("xs"))
    body = body.select(
        "message_id", F.array_join(F.transform("xs", lambda v: v["t"]), "\n").alias("text"),
        F.array_compact(F.transform("xs", lambda v: v["a"])).alias("actions"))
    role = F.get_json_object("data", "$.role")
    d = message.select(F.col("id").alias("message_id"), "session_id", "time_created",
                       F.coalesce(role, empty).alias("role")).join(body, "message_id")
    d = running(d, ["session_id"], ["time_created", "message_id"], F.floor(F.col("time_created") / 3600000), {
        "seq": Run("sum", F.lit(1).cast("long"))})
    user, agent = F.col("role") == "user", F.col("role") == "assistant"
    return conform(d.select(
        F.col("session_id").alias("stream_id"), F.col("message_id").alias("turn_id"), "seq",
        F.timestamp_millis("time_created").alias("ts"), F.col("role").alias("speaker"),
        F.when(user, "human").when(agent, "agent").otherwise("unknown").alias("speaker_class"), "text", "actions",
        F.when(user, "typed").otherwise("").alias("input_mode"),
        _meta(("record_type", F.col("role")), ("input_mode", F.when(user, "typed"))).alias("metadata")))


# ---- catalogue ----------------------------------------------------------------------------------
def catalogue(spark: SparkSession, root: str, head_lines: int = 200) -> DataFrame:
    """Sessions under a folder, without decoding them: id, project, parent, root, bytes, modified.

    Path facts come from file metadata; the working directory from the first lines of the file.
    """
    meta = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").format(
        "binaryFile").load(root).select(F.col("path"), F.col("length").alias("bytes"),
                                        F.col("modificationTime").alias("modified"))
    base = root.rstrip("/") + "/"
    rel = F.substring_index("path", base, -1)
    lines = read_lines(spark, root).where(F.col("pos") <= head_lines)
    cwd = F.get_json_object("line", "$.cwd")
    head = lines.groupBy(F.regexp_replace("path", r"\Afile:/+", "file:/").alias("path")).agg(
        F.min_by(F.struct(cwd.alias("cwd"), (F.get_json_object("line", "$.isSidechain") == "true").alias("side")),
                 F.when(F.coalesce(cwd, F.lit("")) != "", F.col("pos"))).alias("h"))
    parts = F.split(rel, "/")
    d = meta.withColumn("path", F.regexp_replace("path", r"\Afile:/+", "file:/")).join(head, "path", "left")
    return d.select(
        _stem(F.col("path")).alias("id"), "path", parts[0].alias("project"), "bytes", "modified",
        F.when(rel.contains("/subagents/"), F.get(parts, F.size(parts) - 3)).alias("parent"),
        F.col("h.cwd").alias("root"), F.coalesce("h.side", F.lit(False)).alias("sidechain"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label lines; comment lines are skipped. Validation is `operators.labels.checked`."""
    d = read_lines(spark, path).where(~F.trim("line").startswith("//"))
    d = parse(d, "session string, record string, family string, start bigint, end bigint, label string, "
                 "kind string, labeler string, text string, note string", "labels")
    zero = lambda n: F.coalesce(F.col(f"r.{n}"), F.lit(0)).cast("long").alias(n)
    return d.select(F.coalesce("r.session", F.lit("")).alias("session"), "r.record", "r.family", zero("start"), zero("end"),
                    "r.label", "r.labeler", "r.note", F.col("pos").alias("li"))
