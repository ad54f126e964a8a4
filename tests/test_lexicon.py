"""Dialect: Spark with the rewritten pattern agrees with RE2 (DuckDB) on the original."""

import random

import duckdb
import pytest

from helmline.lexicon import BASELINE, BASELINE_MARKERS, DEFAULT, Lexicon, Profile

PIECES = (
    "no", "énoé", "x", "Only", "only", "re-only", "STOP", "stop !", "stop.", "never mind", "scope", "i meant",
    "İ", "ſtop", "Keep", "keep", "that's not", "I said", "again", "`code`", "src/a.py", "AB-12", "v1.2.3",
    "M4b", "#12", "issue #7", "the same thing", "this is the third time", "fix", "add", "===", "ok ", "===\n",
    "don't", "do not touch", "follow-up", "Make sure", "you", "yourself", "task: go", "new session",
    "hand it off to a new agent", "start another new session", "é", "_", "-", ".", "/", "\n", "\t", " ",
    "forget about it", "you can now drop", "no longer needed", "drop the rule", "restored", "i went ahead",
)


def texts(n=600):
    rng = random.Random(5)
    return ["".join(rng.choice(PIECES) + rng.choice(("", " ", " ", "-", "é"))
                    for _ in range(rng.randint(1, 7))) for _ in range(n)]


def test_markers_agree_with_re2(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {
        r.id: r for r in df.select(
            "id",
            *[DEFAULT.match(g, df.t).alias(g) for g in BASELINE_MARKERS],
            *[DEFAULT.find(g, df.t).alias(g + "__f") for g in BASELINE_MARKERS],
            *[DEFAULT.position(g, df.t).alias(g + "__p") for g in BASELINE_MARKERS],
            DEFAULT.match_any(list(BASELINE_MARKERS), df.t).alias("any_"),
        ).collect()
    }
    con = duckdb.connect()
    for g, p in BASELINE_MARKERS.items():
        pat = p if BASELINE.markers[g].case_sensitive else "(?i)" + p
        for i, t in rows:
            m, f = con.execute("select regexp_matches($1, $2), regexp_extract($1, $2)",
                               [t, pat]).fetchone()
            assert got[i][g] == m, (g, t)
            assert got[i][g + "__f"] == f, (g, t)
            assert (got[i][g + "__p"] > 0) == m
    for i, t in rows:
        assert got[i]["any_"] == any(got[i][g] for g in BASELINE_MARKERS), t


def test_overlay_adds_and_replaces():
    over = Profile.from_json(
        '{"name":"mine","markers":{"acceptance":{"phrases":["top"]},'
        '"meta":{"phrases":["x y"],"replace":true},"negative":{"pattern":"","replace":true}},'
        '"parameters":{"bulk_paste_lines":10}}')
    p = BASELINE.overlay(over)
    assert p.name == "baseline+mine" and p.parameters["bulk_paste_lines"] == 10
    assert p.markers["acceptance"].phrases == ("top",) and p.markers["acceptance"].pattern
    assert p.markers["meta"].pattern == "" and "negative" not in Lexicon(p).java
    assert Lexicon(p).rules_hash() != DEFAULT.rules_hash()
    assert Lexicon(BASELINE.overlay(None)).rules_hash() == DEFAULT.rules_hash()


@pytest.mark.parametrize("text", ['{"name":"x","oops":1}', '{"version":"1"}',
                                  '{"name":"x","markers":{"a":{"words":[]}}}'])
def test_profile_is_strict(text):
    with pytest.raises(ValueError):
        Profile.from_json(text)
