import json

import pytest

from helmline.sources import transcripts as TR


def put(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    p = folder / name
    p.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n", encoding="utf-8")
    return p


def got(df):
    return [r.asDict(recursive=True) for r in df.orderBy("stream_id", "seq").collect()]


def acts(rec):
    return [(a["verb"], a["targets"], a["argv"], a["failed"]) for a in rec["actions"] or []]


WANT = [("read", ["src/a.go"], [], False), ("write", ["src/a.go"], [], False),
        ("execute", [], ["make test"], True), ("write", ["/etc/hosts"], [], False), ("unknown", [], [], False)]


def test_generic(spark, tmp_path):
    put(tmp_path, "g.jsonl", [
        {"stream_id": "g1", "seq": 7, "speaker": "user", "timestamp": "2026-03-02T09:00:00+01:00", "text": "é go"},
        "",
        {"stream_id": "g1", "speaker": "model", "timestamp": "soon", "text": "", "root": "/w/p", "actions": [
            {"verb": "read", "targets": ["/w/p/src/a.go"]}, {"verb": "write", "targets": ["/w/p/./src/a.go"]},
            {"verb": "execute", "argv": ["make test"], "failed": True},
            {"verb": "write", "targets": ["/etc/hosts"]}, {"verb": "dance"}]},
        {"stream_id": "g1", "turn_id": "x", "speaker": "robot", "text": "t", "sidechain": True},
    ])
    r = got(TR.read_generic(spark, str(tmp_path)))
    assert [x["seq"] for x in r] == [1, 2, 3]
    assert [x["speaker_class"] for x in r] == ["human", "agent", "unknown"]
    assert [x["turn_id"] for x in r] == ["seq-1", "seq-2", "x"]
    assert r[0]["ts"].isoformat() == "2026-03-02T08:00:00" and r[1]["ts"] is None
    assert r[0]["metadata"] == {"source_seq": "7"} and r[2]["sidechain"]
    assert acts(r[1]) == WANT
    raw = (tmp_path / "g.jsonl").read_bytes()
    for x in r:
        line = raw[x["source"]["offset"]:].split(b"\n", 1)[0]
        import hashlib
        assert hashlib.sha256(line).hexdigest() == x["source"]["record_sha256"]


def test_bad_line_is_an_error_with_offset(spark, tmp_path):
    put(tmp_path, "g.jsonl", [{"stream_id": "g", "speaker": "user", "text": "a"}, "{oops"])
    with pytest.raises(Exception, match="offset"):
        TR.read_generic(spark, str(tmp_path)).collect()


def test_claude(spark, tmp_path):
    base = {"sessionId": "c1", "cwd": "/w/p", "timestamp": "2026-03-02T09:00:00.5Z"}
    tool = lambda i, n, **inp: {"type": "tool_use", "id": i, "name": n, "input": inp}
    put(tmp_path, "c.jsonl", [
        {**base, "type": "user", "uuid": "u1", "message": {"role": "user", "content": "[fix] it"}},
        {**base, "type": "assistant", "uuid": "a1", "message": {"content": [
            {"type": "text", "text": "ok"}, tool("1", "Read", file_path="/w/p/src/a.go"),
            tool("2", "Edit", file_path="/w/p/src/a.go"), tool("3", "Bash", command="make test"),
            tool("4", "Write", file_path="/etc/hosts"), tool("5", "Dance"), tool("6", "AskUserQuestion")]}},
        {**base, "type": "user", "message": {"content": [
            {"type": "tool_result", "tool_use_id": "3", "is_error": True, "content": "boom"}]}, "toolUseResult": "x"},
        {**base, "type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "6", "content": "q"}]},
         "toolUseResult": {"answers": {"b": "two", "a": "one"}, "annotations": {"z": {"notes": "why"}}}},
        {**base, "type": "user", "isMeta": True, "message": {"content": "meta"}},
        {**base, "type": "user", "isCompactSummary": True, "message": {"content": "sum"}},
        {**base, "type": "user", "message": {"content": "<bash-input>ls -l</bash-input>"}},
        {**base, "type": "user", "message": {"content": "<command-name>/clear</command-name><x>"}},
        {**base, "type": "user", "message": {"content": [{"type": "text", "text": "[Request interrupted by user]"}]}},
        {**base, "type": "attachment", "attachment": {"type": "queued_command", "prompt": [
            {"type": "text", "text": "look"}, {"type": "image"}], "commandMode": "prompt", "origin": {"kind": "human"}}},
        {**base, "type": "ai-title", "aiTitle": "Name"},
        {**base, "type": "system", "content": "note"},
        {**base, "type": "strange"},
    ])
    r = got(TR.read_claude(spark, str(tmp_path)))
    assert [(x["speaker_class"], x["input_mode"], x["text"]) for x in r] == [
        ("human", "typed", "[fix] it"), ("agent", "", "ok"), ("tool", "", "boom"),
        ("human", "structured_answer", "one\ntwo\nwhy"), ("system", "", "meta"),
        ("system", "compact_summary", "sum"), ("human", "shell_escape", "ls -l"),
        ("human", "cli_command", "/clear"), ("system", "interrupt", "[Request interrupted by user]"),
        ("human", "typed", "look"), ("system", "", ""), ("system", "", "note"), ("unknown", "", "")]
    assert acts(r[1])[:5] == WANT and acts(r[1])[5][0] == "ask"
    assert r[10]["metadata"]["stream_name"] == "Name" and r[1]["metadata"]["tool_name"].startswith("Read,Edit")


def test_qwen(spark, tmp_path):
    base = {"sessionId": "q1", "cwd": "/w/p", "timestamp": "2026-03-02T09:00:00Z"}
    call = lambda i, n, **a: {"functionCall": {"id": i, "name": n, "args": a}}
    put(tmp_path, "q.jsonl", [
        {**base, "type": "user", "provenance": "real_user", "message": {"parts": [{"text": "go"}]}},
        {**base, "type": "user", "message": {"parts": [{"text": "injected"}]}},
        {**base, "type": "assistant", "message": {"parts": [
            {"text": "hm", "thought": True}, {"text": "ok"}, call("1", "read_file", file_path="/w/p/src/a.go"),
            call("2", "edit", file_path="/w/p/src/a.go"), call("3", "run_shell_command", command="make test"),
            call("4", "write_file", file_path="/etc/hosts"), call("5", "dance")]}},
        {**base, "type": "tool_result", "message": {"parts": [
            {"functionResponse": {"id": "3", "response": {"error": "bad"}}}]}},
        {**base, "type": "system", "subtype": "slash_command",
         "systemPayload": {"phase": "invocation", "rawCommand": "/x"}},
    ])
    r = got(TR.read_qwen(spark, str(tmp_path)))
    assert [(x["speaker_class"], x["input_mode"], x["text"]) for x in r] == [
        ("human", "typed", "go"), ("system", "", "injected"), ("agent", "", "ok"), ("tool", "", "bad"),
        ("human", "cli_command", "/x")]
    assert acts(r[2]) == WANT


def test_codex(spark, tmp_path):
    ev = lambda **p: {"timestamp": "2026-03-02T09:00:00Z", "type": "event_msg", "payload": p}
    put(tmp_path, "rollout.jsonl", [
        {"type": "session_meta", "payload": {"id": "x1", "cwd": "/w/p"}}, "{broken",
        ev(type="user_message", message="go", turn_id="t1"), ev(type="user_message", message="  "),
        {"type": "response_item", "payload": {"type": "message"}},
        ev(type="patch_apply_end", changes={"/w/p/b.py": {"type": "add"}, "/w/p/a.py": {"type": "add"}}, success=False),
        ev(type="turn_aborted", reason="interrupted"),
        ev(type="item_completed", item={"type": "CommandExecution", "id": "i1", "command": ["ls"], "exit_code": 2}),
        ev(type="item_completed", item={"type": "AgentMessage", "content": [{"type": "Text", "text": "hi"}]}),
    ])
    r = got(TR.read_codex(spark, str(tmp_path)))
    assert [x["seq"] for x in r] == [1, 2, 3, 4, 5] and {x["stream_id"] for x in r} == {"x1"}
    assert [(x["speaker_class"], x["text"]) for x in r] == [
        ("human", "go"), ("agent", ""), ("system", "turn aborted: interrupted"), ("agent", ""), ("agent", "hi")]
    assert acts(r[1]) == [("write", ["a.py", "b.py"], [], True)] and r[2]["input_mode"] == "interrupt"
    assert acts(r[3]) == [("execute", [], ["ls"], True)] and r[3]["turn_id"] == "i1"


def test_opencode(spark):
    s = spark.createDataFrame([("ses1", "/w/p")], "id string, directory string")
    m = spark.createDataFrame([("m1", "ses1", 1000, '{"role":"user"}'), ("m2", "ses1", 2000, '{"role":"assistant"}'),
                               ("m3", "ses1", 3000, '{"role":"assistant"}')],
                              "id string, session_id string, time_created long, data string")
    p = spark.createDataFrame([
        ("m1", "ses1", 1001, '{"type":"text","text":"go"}'), ("m1", "ses1", 1002, '{"type":"text","text":"x","synthetic":true}'),
        ("m2", "ses1", 2001, '{"type":"tool","tool":"bash","state":{"status":"ok","input":{"command":"ls"},"metadata":{"exit":1}}}'),
        ("m2", "ses1", 2002, '{"type":"tool","tool":"edit","state":{"status":"ok","input":{"filePath":"/w/p/a.py"}}}'),
        ("m3", "ses1", 3001, '{"type":"step"}')],
        "message_id string, session_id string, time_created long, data string")
    r = got(TR.read_opencode(s, m, p))
    assert [(x["turn_id"], x["seq"], x["speaker_class"], x["text"]) for x in r] == [
        ("m1", 1, "human", "go"), ("m2", 2, "agent", "")]
    assert acts(r[1]) == [("execute", [], ["ls"], True), ("write", ["a.py"], [], False)]


def test_catalogue(spark, tmp_path):
    put(tmp_path / "proj", "s1.jsonl", [{"cwd": ""}, {"cwd": "/w/p", "isSidechain": True}])
    put(tmp_path / "proj" / "s1" / "subagents", "k.jsonl", [{"x": 1}])
    r = {x["id"]: x.asDict() for x in TR.catalogue(spark, str(tmp_path)).collect()}
    assert r["s1"]["project"] == "proj" and r["s1"]["root"] == "/w/p" and r["s1"]["sidechain"]
    assert r["k"]["parent"] == "s1" and r["k"]["root"] is None and r["k"]["bytes"] > 0


def test_split_files_keep_order_and_offsets(spark, tmp_path):
    rows = [{"stream_id": "big", "speaker": "user", "text": f"é line {i} " + "x" * (i % 50)} for i in range(400)]
    put(tmp_path, "big.jsonl", rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        r = got(TR.read_generic(spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [x["text"] for x in r] == [x["text"] for x in rows]
    raw = (tmp_path / "big.jsonl").read_bytes()
    assert all(raw[x["source"]["offset"] - 1:][:1] in (b"\n", b"") or x["seq"] == 1 for x in r)
    assert [x["source"]["offset"] for x in r] == sorted(x["source"]["offset"] for x in r)


def test_opencode_ties_and_unknown_sessions(spark):
    """Parts of equal time follow their ids in whatever order they were exported; a missing session loses nothing."""
    text = lambda t: json.dumps(dict(type="text", text=t))
    s = spark.createDataFrame([("other", "/r")], "id string, directory string")
    m = spark.createDataFrame([("m1", "gone", 5, json.dumps(dict(role="user")))], "id string, session_id string, time_created long, data string")
    rows = [("p3", "m1", "gone", 7, text("third")), ("p1", "m1", "gone", 7, text("first")), ("p2", "m1", "gone", 7, text("second"))]
    for order in (rows, rows[::-1]):
        p = spark.createDataFrame(order, "id string, message_id string, session_id string, time_created long, data string")
        assert [(r.stream_id, r.text) for r in TR.read_opencode(s, m, p.repartition(3)).collect()] == [("gone", "first\nsecond\nthird")]
