"""The conversations table as lines of each transcript format, and the records that reading them has to give.

Every row is rendered with its whole text. Roles, wrappers, calls, failures and missing fields follow by arithmetic from
(conv_id, turn); call ids are used again and again, so that a failure has to find the latest call. `BASE_SQL` runs in Spark
and in DuckDB; `EXPECTED` is DuckDB SQL over it, written from the rules of the formats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helmline.functions.ordered import RECORD_BLOCK, Run, block_of, running
from helmline.sources import transcripts as TR

BASE_SQL = """SELECT conv_id, turn, role, coalesce(text, '') AS text,
  (conv_id * 13 + turn * 7) % 10 AS g, (conv_id * 5 + turn) % 7 AS h,
  CASE WHEN (conv_id + turn * 3) % 11 <> 0 THEN 1709251200 + conv_id * 600 + turn * 45 END AS ts_s,
  concat('src/f', CAST((conv_id + turn) % 3 AS VARCHAR(3)), '.py') AS file,
  concat('conv-', CAST(conv_id AS VARCHAR(20))) AS sid, CAST(turn AS VARCHAR(20)) AS t
FROM conversations"""

c, lit, arr, st = F.col, F.lit, F.array, F.struct
ROOT = "/w/p"


def _base(spark: SparkSession, table: DataFrame) -> DataFrame:
    d = spark.sql(BASE_SQL.replace("FROM conversations", "FROM {conversations}"), conversations=table)
    agent = c("role") == "assistant"
    return d.withColumns({
        "stamp": F.date_format(F.timestamp_seconds("ts_s"), "yyyy-MM-dd'T'HH:mm:ssXXX"), "writes": c("g").isin(0, 3, 4, 6),
        "runs": c("g").isin(3, 4), "fails": agent & (c("g") == 4), "under_root": F.concat(lit(f"{ROOT}/./"), c("file"))})


def _json(**fields) -> Column:
    """An object without its null fields."""
    return F.to_json(st(*[(v if isinstance(v, Column) else lit(v)).alias(k) for k, v in fields.items()]))


def _lines(d: DataFrame, *each) -> DataFrame:
    """Lines as the readers take them, from up to ten lines per row; a null is no line. A conversation is a file."""
    d = d.select("conv_id", "turn", F.posexplode(arr(*each)).alias("sub", "line")).where("line is not null")
    d = d.select(F.concat(lit("/t/conv-"), c("conv_id").cast("string"), lit(".jsonl")).alias("path"),
                 (c("turn") * 10 + c("sub")).alias("at"), "line")
    d = running(d, ["path"], ["at"], block_of(c("at"), RECORD_BLOCK), {
        "offset": Run("sum", F.octet_length("line").cast("long") + 1, strict=True), "pos": Run("sum", lit(1).cast("long"))},
        reread=True)
    return d.select("path", "pos", F.coalesce("offset", lit(0)).alias("offset"), "line", F.sha2("line", 256).alias("record_sha256"))


def generic(d: DataFrame) -> DataFrame:
    act = lambda verb, target, argv, bad: st(
        lit(verb).alias("verb"), (arr(target) if target is not None else lit(None).cast("array<string>")).alias("targets"),
        (arr(lit(argv)) if argv else lit(None).cast("array<string>")).alias("argv"), lit(bad).alias("failed"))
    acts = F.array_compact(arr(F.when(c("writes"), act("write", c("under_root"), None, False)), F.when(c("fails"), act("execute", None, "make test", True)),
                               F.when(c("g") == 7, act("dance", lit("/etc/hosts"), None, False))))
    speaker = F.when((c("role") == "user") & (c("conv_id") % 2 == 1), "operator").when(
        c("role") == "user", "user").when(c("g") == 9, "robot").when(c("role") == "assistant", "model").otherwise(c("role"))
    return _lines(d, _json(
        stream_id=F.when(c("conv_id") % 5 != 0, c("sid")), turn_id=F.when(c("g") % 2 == 0, F.concat(lit("u"), "t")), seq=c("turn"),
        timestamp=F.coalesce("stamp", lit("soon")), speaker=speaker, text=c("text"), root=ROOT, sidechain=c("g") == 8,
        actions=F.when(c("role") == "assistant", acts)))


def claude(d: DataFrame) -> DataFrame:
    def line(kind, said=None, **more):
        message = {} if said is None else {"message": st(said.alias("content"))}
        return _json(type=kind, sessionId=F.when(c("conv_id") % 5 != 0, c("sid")), cwd=ROOT, timestamp=c("stamp"),
                     uuid=F.when(c("g") % 2 == 0, F.concat(lit("u"), "t")), isSidechain=c("g") == 8, **message, **more)

    block = "struct<type:string,text:string,name:string,id:string,input:struct<file_path:string,command:string>>"
    none = lambda: lit(None).cast("string")
    part = lambda kind, text=None, name=None, id=None, path=None, command=None: st(*[
        (none() if v is None else v if isinstance(v, Column) else lit(v)) for v in (kind, text, name, id)],
        st(none() if path is None else path, none() if command is None else lit(command))).cast(block)
    wrapped = lambda tag: F.concat(lit(f"<{tag}>"), "text", lit(f"</{tag}>"))
    h = c("h")
    said = (F.when(h == 0, line("user", c("text"), isMeta=True)).when(h == 1, line("user", wrapped("bash-input")))
            .when(h == 2, line("user", wrapped("bash-stdout"))).when(h == 3, line("user", arr(part("text", c("text")))))
            .when(h == 4, line("user", F.concat(lit("[Request interrupted by user] "), "text")))
            .when(h == 5, line("user", c("text"), isCompactSummary=True)).otherwise(line("user", c("text"))))
    blocks = F.array_compact(arr(part("text", c("text")), F.when(c("writes"), part("tool_use", name="Edit", id="e", path=c("under_root"))),
                                 F.when(c("runs"), part("tool_use", name="Bash", id="b", command="make test"))))
    result = st(lit("tool_result").alias("type"), lit("b").alias("tool_use_id"), lit(True).alias("is_error"),
                F.concat(lit("boom "), "t").alias("content"))
    main = (F.when(c("role") == "user", said).when(c("role") == "system", line("system", content=c("text")))
            .when(c("g") == 9, line("strange")).otherwise(line("assistant", blocks)))
    return _lines(d, main, F.when(c("fails"), line("user", arr(result))))


def qwen(d: DataFrame) -> DataFrame:
    def line(kind, parts=None, **more):
        message = {} if parts is None else {"message": st(parts.alias("parts"))}
        return _json(type=kind, sessionId=F.when(c("conv_id") % 5 != 0, c("sid")), cwd=ROOT, timestamp=c("stamp"),
                     uuid=F.when(c("g") % 2 == 0, F.concat(lit("u"), "t")), isSidechain=c("g") == 8, **message, **more)

    said = arr(st(c("text").alias("text")))
    slash = st(lit("invocation").alias("phase"), c("text").alias("rawCommand"))
    user = F.when(c("h") < 2, line("user", said)).when(
        c("h") == 2, line("system", subtype="slash_command", systemPayload=slash)).otherwise(line("user", said, provenance="real_user"))
    kind = ("struct<text:string,thought:boolean,functionCall:struct<id:string,name:string,"
            "args:struct<file_path:string,command:string>>>")
    null = lambda t: lit(None).cast(t)
    no_call = null("struct<id:string,name:string,args:struct<file_path:string,command:string>>")
    text = lambda v, hidden=False: st(v, lit(True) if hidden else null("boolean"), no_call).cast(kind)
    call = lambda id, name, path, command: st(null("string"), null("boolean"), st(
        lit(id), lit(name), st(null("string") if path is None else path, null("string") if command is None else lit(command)))).cast(kind)
    parts = F.array_compact(arr(text(lit("hm"), True), text(c("text")), F.when(c("writes"), call("e", "edit", c("under_root"), None)),
                                F.when(c("runs"), call("b", "run_shell_command", None, "make test"))))
    failed = arr(st(st(lit("b").alias("id"), st(F.concat(lit("boom "), "t").alias("error")).alias("response")).alias("functionResponse")))
    main = F.when(c("role") == "user", user).when(c("role") == "system", line("system")).when(
        c("g") == 9, line("strange")).otherwise(line("assistant", parts))
    return _lines(d, main, F.when(c("fails"), line("tool_result", failed)))


def codex(d: DataFrame) -> DataFrame:
    event = lambda **p: _json(timestamp=c("stamp"), type="event_msg", payload=st(
        *[(v if isinstance(v, Column) else lit(v)).alias(k) for k, v in p.items()]))
    turn = F.concat(lit("t"), "t")
    item = lambda kind, id, **more: st(lit(kind).alias("type"), id.alias("id"), *[v.alias(k) for k, v in more.items()])
    head = _json(type="session_meta", payload=st(c("sid").alias("id"), lit(ROOT).alias("cwd")))
    first = c("first")
    user = (F.when(c("h") == 4, event(type="turn_aborted", reason="interrupted", turn_id=turn))
            .when(c("h") == 3, event(type="item_completed", turn_id=turn, item=item(
                "UserMessage", F.concat(lit("i"), "t"), content=arr(st(lit("Text").alias("type"), c("text").alias("text"))))))
            .otherwise(event(type="user_message", message=c("text"), turn_id=turn)))
    main = F.when(c("role") == "user", user).when(
        c("role") == "assistant", event(type="agent_message", message=c("text"), turn_id=turn)).otherwise(
        _json(type="response_item", payload=st(lit("message").alias("type"))))
    changed = st(lit("add").alias("type"))
    patch = event(type="patch_apply_end", turn_id=turn, success=c("g") != 3, changes=F.create_map(
        F.concat(lit(f"file://{ROOT}/"), c("file")), changed, lit(f"file://{ROOT}/a.py"), changed))
    ran = event(type="item_completed", turn_id=turn, item=item(
        "CommandExecution", F.concat(lit("i"), "t", lit("-c")), command=arr(lit("make"), lit("test")), exit_code=lit(2)))
    more = F.when(c("role") == "assistant", F.when(c("g").isin(0, 3, 6), patch).when(c("g") == 4, ran))
    at = d.groupBy("conv_id").agg(F.min("turn").alias("first"))
    return _lines(d.join(at, "conv_id"), F.when(c("turn") == first, head), F.when(c("turn") == first, lit("{broken")), main, more)


def opencode(d: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables session, message and part; every fifth session isn't exported. All parts of a message have one time."""
    session = d.where("conv_id % 5 <> 0").select(c("sid").alias("id"), lit(ROOT).alias("directory")).distinct()
    made = ((1709251200 + c("conv_id") * 600 + c("turn") * 45) * 1000).alias("time_created")
    mid = F.concat("sid", lit("-m"), "t")
    message = d.select(mid.alias("id"), c("sid").alias("session_id"), made, _json(role=c("role")).alias("data"))
    state = lambda path, command, status, code: st(
        lit(status).alias("status"), st(path.alias("filePath"), lit(command).cast("string").alias("command")).alias("input"),
        st(lit(code).alias("exit")).alias("metadata"))
    none, talks = lit(None).cast("string"), (c("role") != "assistant") | (c("g") != 9)
    parts = arr(
        F.when(talks, _json(type="text", text=c("text"))), F.when(talks, _json(type="text", text="x", synthetic=True)),
        F.when(talks & (c("g") % 3 == 0), _json(type="text", text="done")),
        F.when(talks & (c("role") == "assistant") & c("writes"), _json(type="tool", tool="edit", state=state(c("under_root"), None, "ok", 0))),
        F.when(c("fails"), _json(type="tool", tool="bash", state=state(none, "make test", "ok", 1))), _json(type="step"))
    part = d.select(c("sid").alias("session_id"), mid.alias("message_id"), made, F.posexplode(parts).alias("n", "data")).where("data is not null")
    return session, message, part.withColumn("id", F.concat(lit("p"), c("n").cast("string")))


READERS = {
    "t01_read_generic": lambda d: TR.decode_generic(generic(d)), "t02_read_claude": lambda d: TR.decode_claude(claude(d)),
    "t03_read_qwen": lambda d: TR.decode_qwen(qwen(d)), "t04_read_codex": lambda d: TR.decode_codex(codex(d)),
    "t04b_read_opencode": lambda d: TR.read_opencode(*opencode(d)),
}


def records(spark: SparkSession, table: DataFrame, name: str) -> DataFrame:
    """The records that the reader of one format gives for the rendered conversations, actions as one string."""
    act = lambda a: F.concat_ws("|", a["verb"], F.array_join(a["targets"], ","), F.array_join(a["argv"], ","),
                                a["failed"].cast("string"))
    return READERS[name](_base(spark, table)).select(
        "stream_id", "turn_id", "seq", F.unix_seconds("ts").alias("ts_s"), "speaker", "speaker_class", "input_mode", "sidechain",
        F.md5("text").alias("text_md5"), F.coalesce(F.array_join(F.transform("actions", act), ";"), lit("")).alias("acts"))


# ---- what reading has to give ---------------------------------------------------------------------
_BLANK = r"regexp_replace(text, '[\s\v\x{85}\p{Z}]+', '', 'g') = ''"
_TAIL = "speaker, speaker_class, input_mode, sidechain, md5(text) AS text_md5, acts"
_WRITE = "CASE WHEN role = 'assistant' AND g IN (0, 3, 4, 6) THEN 'write|' || file || '||false' END"


def _expected(rows: str, turn: str) -> str:
    return (f"WITH base AS ({BASE_SQL}), rows AS ({rows}), placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, sub) "
            f"AS seq FROM rows) SELECT sid AS stream_id, {turn} AS turn_id, seq, ts_s, {_TAIL} FROM placed")


_TURN = "coalesce(tid, 'seq-' || seq)"
_BASH = "CASE WHEN role = 'assistant' AND g IN (3, 4) THEN 'execute||make test|' || (g = 4) END"
_CLASS = "CASE speaker WHEN 'user' THEN 'human' WHEN 'operator' THEN 'human' WHEN 'model' THEN 'agent' WHEN 'assistant' THEN 'agent' {more} END"
_MORE = "WHEN 'system' THEN 'system' WHEN 'tool' THEN 'tool' ELSE 'unknown'"


def _named(inner: str, cls: str = _CLASS.format(more=_MORE)) -> str:
    return f"SELECT *, {cls} AS speaker_class FROM ({inner})"


_UUID = "CASE WHEN g % 2 = 0 THEN 'u' || t END AS tid"
_BLOCK_ROWS = """SELECT conv_id, turn, 0 AS sub, sid, {uuid}, ts_s, g = 8 AS sidechain, {speaker} AS speaker, {mode} AS input_mode, {text} AS text,
  {acts} AS acts FROM base UNION ALL
SELECT conv_id, turn, 1, sid, {uuid}, ts_s, false, 'tool', '', 'boom ' || t, '' FROM base WHERE role = 'assistant' AND g = 4"""
_CALLS = f"CASE WHEN g = 9 THEN '' ELSE concat_ws(';', {_WRITE}, {_BASH}) END"

EXPECTED = {
    "t01_read_generic": _expected(_named(f"""SELECT conv_id, turn, 0 AS sub, sid, {_UUID}, ts_s, g = 8 AS sidechain, CASE WHEN role = 'user' AND conv_id % 2 = 1 THEN 'operator'
  WHEN role = 'user' THEN 'user' WHEN g = 9 THEN 'robot' WHEN role = 'assistant' THEN 'model' ELSE role END AS speaker, '' AS input_mode, text,
  concat_ws(';', {_WRITE}, CASE WHEN role = 'assistant' AND g = 4 THEN 'execute||make test|true' WHEN role = 'assistant' AND g = 7
  THEN 'unknown|/etc/hosts||false' END) AS acts FROM base"""), _TURN),
    "t02_read_claude": _expected(_named(_BLOCK_ROWS.format(
        uuid=_UUID, acts=_CALLS,
        speaker="CASE WHEN role = 'user' THEN CASE WHEN h IN (0, 4, 5) THEN 'system' WHEN h = 2 THEN 'tool' ELSE 'user' END "
                "WHEN role = 'system' THEN 'system' WHEN g = 9 THEN 'strange' ELSE 'assistant' END",
        mode="CASE WHEN role <> 'user' THEN '' ELSE CASE h WHEN 1 THEN 'shell_escape' WHEN 3 THEN 'typed' WHEN 4 THEN 'interrupt' "
             "WHEN 5 THEN 'compact_summary' WHEN 6 THEN 'typed' ELSE '' END END",
        text="CASE WHEN role = 'user' AND h = 4 THEN '[Request interrupted by user] ' || text WHEN role NOT IN ('user', 'system') AND g = 9 THEN '' "
             "ELSE text END")), _TURN),
    "t03_read_qwen": _expected(_named(_BLOCK_ROWS.format(
        uuid=_UUID, acts=_CALLS,
        speaker="CASE WHEN role = 'user' THEN CASE WHEN h < 2 OR h = 2 AND text = '' THEN 'system' ELSE 'user' END WHEN role = 'system' THEN 'system' "
                "WHEN g = 9 THEN 'strange' ELSE 'assistant' END",
        mode="CASE WHEN role <> 'user' OR h < 2 OR h = 2 AND text = '' THEN '' WHEN h = 2 THEN 'cli_command' ELSE 'typed' END",
        text="CASE WHEN role = 'system' OR role <> 'user' AND g = 9 THEN '' ELSE text END")), _TURN),
    "t04_read_codex": _expected(_named(f"""SELECT conv_id, turn, 2 AS sub, sid, CASE WHEN role = 'user' AND h = 3 THEN 'i' ELSE 't' END || t AS tid, ts_s, false AS sidechain,
  CASE WHEN role = 'user' AND h = 4 THEN 'system' ELSE role END AS speaker, CASE WHEN role <> 'user' THEN '' WHEN h = 4 THEN 'interrupt' ELSE 'typed' END AS input_mode,
  CASE WHEN role = 'user' AND h = 4 THEN 'turn aborted: interrupted' ELSE text END AS text, '' AS acts
  FROM base WHERE role IN ('user', 'assistant') AND (role = 'user' AND h = 4 OR NOT ({_BLANK})) UNION ALL
SELECT conv_id, turn, 3, sid, CASE WHEN g = 4 THEN 'i' || t || '-c' ELSE 't' || t END, ts_s, false, 'assistant', '', '',
  CASE WHEN g = 4 THEN 'execute||make,test|true' ELSE 'write|a.py,' || file || '||' || (g = 3) END FROM base WHERE role = 'assistant' AND g IN (0, 3, 4, 6)"""), _TURN),
    # Parts of one message come in the order of their ids.
    "t04b_read_opencode": _expected(_named(f"""SELECT conv_id, turn, 0 AS sub, sid, sid || '-m' || t AS tid, 1709251200 + conv_id * 600 + turn * 45 AS ts_s, false AS sidechain, role AS speaker,
  CASE WHEN role = 'user' THEN 'typed' ELSE '' END AS input_mode, concat_ws(chr(10), CASE WHEN NOT ({_BLANK}) THEN text END, CASE WHEN g % 3 = 0 THEN 'done' END) AS text,
  concat_ws(';', CASE WHEN role = 'assistant' AND g IN (0, 3, 4, 6) THEN 'write|' || CASE WHEN conv_id % 5 = 0 THEN '/w/p/' ELSE '' END || file || '||false' END,
  CASE WHEN role = 'assistant' AND g = 4 THEN 'execute||make test|true' END) AS acts FROM base
  WHERE NOT (role = 'assistant' AND g = 9) AND (NOT ({_BLANK}) OR g % 3 = 0 OR role = 'assistant' AND g IN (4, 6))""",
        cls="CASE speaker WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'agent' ELSE 'unknown' END"), "tid"),
}
