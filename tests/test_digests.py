"""Digests of files and of ordered lines against hashlib."""

import hashlib

from helmline.functions.ordered import Layout, layout
from helmline.operators.corpus import file_digest, tree_digest

LINES = "k string, name string, i long, t string"


def test_file_digest_of_many_lines(spark):
    long = [("a", "b.jsonl", i, f"line {i} \u00fc\n") for i in range(25_000)]
    rows = [*long, ("a", "a.jsonl", 0, "first\n"), ("a", "c.jsonl", 0, None), ("b", "x", 0, "no line end"), ("c", "", 0, ""), (None, "x", 0, "y"),
            ("d", None, 1, "two"), ("d", None, 0, "one")]
    got = {r.k: r.sha256 for r in file_digest(spark.createDataFrame(rows, LINES).repartition(7), "k", "name", "i", "t").collect()}
    body = "".join(r[3] for r in long).encode()
    want = {"a": b"a.jsonl\0first\nb.jsonl\0" + body + b"c.jsonl\0", "b": b"x\0no line end", "c": b"\0", "d": b"\0onetwo"}
    assert got == {k: hashlib.sha256(v).hexdigest() for k, v in want.items()}
    assert file_digest(spark.createDataFrame([], LINES), "k", "name", "i", "t").count() == 0


def tree(texts, rows):
    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    level = [sha(t or "") for t in texts]
    for _ in range(4):
        level = [sha("".join(level[i:i + rows])) for i in range(0, len(level), rows)]
    return level[0]


def test_tree_digest(spark):
    keys = {"a": [f"t{i}" for i in range(75)], "b": ["x"], "c": ["", None, "z"], "d": ["z", None, ""]}
    rows = [(k, "", 3 * i, t) for k, ts in keys.items() for i, t in enumerate(ts)] + [(None, "", 0, "x")]
    d = spark.createDataFrame(rows, LINES).repartition(5)
    for n in (3, 4096):
        for shape in (Layout(), Layout(record_rows=8)):
            with layout(shape):
                got = {r.k: r.sha256 for r in tree_digest(d, "k", "i", "t", rows=n).collect()}
            assert got == {k: tree(ts, n) for k, ts in keys.items()}
    assert len(set(got.values())) == 4
    assert tree_digest(d.limit(0), "k", "i", "t").count() == 0
