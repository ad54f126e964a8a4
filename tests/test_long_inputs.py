"""Long texts and large keys: the same result in every size."""

import hashlib

from pyspark.sql import Row
from pyspark.sql import functions as F

from helmline.functions import text as T
from helmline.operators.corpus import content_hash
from helmline.sources import linking


def test_sentences_tile_a_long_text(spark):
    text = "".join(f"Sentence {i} of many. Second part?\n> quoted é {i}\n" for i in range(1500))
    d = spark.createDataFrame([(text,), ("",), (None,)], "v string").select(T.sentences(F.col("v")).alias("s"))
    got = [r["s"] for r in d.collect()]
    long = next(s for s in got if s)
    raw = text.encode()
    assert [x["pos"] for x in long] == list(range(6000))  # the line end after a mark is a span of its own
    assert [x["start"] for x in long] == [0] + [x["end"] for x in long][:-1] and long[-1]["end"] == len(raw)
    assert all(raw[x["start"]:x["end"]].decode().strip() == x["text"] for x in long)
    assert sum(x["contained"] for x in long) == 1500
    assert sorted(map(str, (s for s in got if not s))) == ["None", "[]"]


def test_lines_of_a_long_file(spark):
    lines = ["" if i % 7 == 3 else f"line {i} ü" for i in range(3000)]
    got = linking.lines_with_offsets(spark.createDataFrame([("f", "\n".join(lines))], "path string, value string"))
    want, at, n = [], 0, 0
    for ln in lines:
        if ln:
            want.append((n, at, ln))
            n += 1
        at += len(ln.encode()) + 1
    assert sorted((r["pos"], r["offset"], r["line"]) for r in got.collect()) == want


def test_an_error_marks_the_latest_call_before_it(spark):
    call, res = Row("path", "pos", "call_id"), Row("path", "pos", "call_id", "is_error")
    calls = spark.createDataFrame([call("f", 1, "a"), call("f", 4, "a"), call("f", 9, "a"), call("g", 2, "a"), call("f", 5, "")])
    results = spark.createDataFrame([res("f", 3, "a", False), res("f", 4, "a", True), res("f", 8, "a", True),
                                     res("f", 8, "a", True), res("g", 1, "a", True), res("f", 6, "", True)])
    got = {(r["path"], r["pos"]): r["failed"] for r in linking.mark_failed(calls, results).collect()}
    assert got == {("f", 1): True, ("f", 4): True, ("f", 9): False, ("g", 2): False, ("f", 5): False}


def test_content_hash_has_one_form(spark):
    def want(texts):
        lanes = [0] * 4
        for i, t in enumerate(texts):
            h = hashlib.sha256(f"{i}\0{t or ''}".encode()).hexdigest()
            lanes = [a ^ int(h[16 * k:16 * k + 15], 16) for k, a in enumerate(lanes)]
        return hashlib.sha256(":".join(map(str, [len(texts), *lanes])).encode()).hexdigest()

    keys = {"short": ["a", None], "long": [f"t{i % 5}" for i in range(10000)], "moved": [None, "a"]}
    rows = [(k, i, t) for k, ts in keys.items() for i, t in enumerate(ts)]
    d = content_hash(spark.createDataFrame(rows, "k string, i int, t string").repartition(5), "k", "i", "t")
    assert {r["k"]: r["sha256"] for r in d.collect()} == {k: want(ts) for k, ts in keys.items()}
