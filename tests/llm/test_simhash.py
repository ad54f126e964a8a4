"""Fingerprints and components against all pairs on small inputs."""

import random

import xxhash
from pyspark.sql import functions as F

from helmline.llm import components, simhash
from tests.llm.helpers import documents


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(keys, linked):
    label = dict(enumerate(keys))
    groups = [{i} for i in label]
    for i in label:
        for j in range(i):
            if linked(i, j):
                a, b = next(g for g in groups if i in g), next(g for g in groups if j in g)
                if a is not b:
                    a |= b
                    groups.remove(b)
    return {i: min((keys[k] for k in g if keys[k] is not None), default=None) for g in groups for i in g}


def test_against_all_pairs(spark):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(60)] + ["É", "日本", "Ab"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(40, 160))) for _ in range(25)]
    rows = list(enumerate(base)) + [(100 + i, t) for i, t in enumerate(base[:8])]
    for k in range(120):
        w = rng.choice(base).split(" ")
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((200 + k, "\t".join(w)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "one two"), (505, "ONE  TWO"), (None, base[3]),
             (None, "alone and without any id at all"), (504, "one two"), (None, None)]
    rng.shuffle(rows)
    want = [plain_fingerprint(t) for _, t in rows]
    least = least_reachable([i for i, _ in rows], lambda i, j: (want[i] ^ want[j]).bit_count() <= 3)
    expect = sorted(((i, f"{want[k]:016x}", least[k]) for k, (i, _) in enumerate(rows)), key=str)
    df = documents(spark, rows).withColumn("fp", F.lit("clash")).withColumn("component", F.lit(0))
    assert sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str) == expect
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_links_find_every_pair_within_three_bits(spark):
    rng = random.Random(9)
    values = {rng.getrandbits(64) for _ in range(40)} | {0, 2 ** 64 - 1}
    for v in list(values):
        for n in (1, 2, 3, 4):
            for _ in range(6):
                values.add(v ^ sum(1 << b for b in rng.sample(range(64), n)))
    signed = [v - 2 ** 64 if v >> 63 else v for v in values]
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) % 2 ** 64).bit_count() <= 3}
    got = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint")).collect()
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in got} == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(400, 500)] + [(7, 7), (None, 3)]
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    rng.shuffle(edges)
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == {x: find(x) for x in parent}
    empty = spark.createDataFrame([], "a bigint, b bigint")
    assert components.components(empty).count() == 0
