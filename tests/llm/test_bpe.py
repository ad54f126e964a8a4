"""Ids equal those of the public library; decoding gives the text back."""

import base64
import random
import subprocess
import sys
import unicodedata

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from helmline.llm import bpe
from tests.llm.helpers import documents


@pytest.fixture(scope="module")
def reference():
    with open(bpe.RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    alphabet = "abe tn\n\t'sé—日本  \x1c\x1f\x85 0129<|>\U0001f600"
    out = ["", " ", "aaaaaaaaaaaaaaaa", "don't we'll I'd", "<|endoftext|>", "a" * 5000, "ab" * 3000 + "!" * 700,
           "x  \n\n y", "  z"]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(300)]
    out += ["".join(rng.choice("etaonish") for _ in range(rng.randrange(20, 400))) for _ in range(100)]
    return out


def test_ids_and_bytes(spark, reference):
    rows = list(enumerate(texts())) + [(None, "null id"), (7, "again"), (7, "again"), (900, None)]
    out = bpe.decode(bpe.encode(documents(spark, rows), keep=("doc_id",), also_text=True)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert list(r.ids) == reference.encode_ordinary(r.text or ""), r.text
        assert bytes(r.decoded) == (r.text or "").encode()


def test_all_code_points_near_spaces(reference):
    own = bpe.codec(bpe.RANKS, public_tokenizers.PATTERN)
    for c in [*range(0, 0x3100), 0xFEFF, 0x1F600]:
        if unicodedata.category(chr(c)) not in ("Cs", "Cn"):  # what is assigned later differs between libraries
            text = f"a {chr(c)}{chr(c)} b1{chr(c)}_{chr(c)}'s"
            assert own.encode([text])[0].tolist() == reference.encode_ordinary(text), hex(c)


def test_queue_order():
    queue, rng = bpe.RankQueue(), random.Random(1)
    held = [(rng.randrange(60000), rng.randrange(50)) for _ in range(2000)]
    for rank, position in held:
        queue.push(rank, position)
    got = []
    while (found := queue.take()) is not None:
        got += [(found[0], position) for position in found[1]]
    assert got == sorted(held)


def test_clashing_columns_and_empty_table(spark):
    df = documents(spark, [(1, "some text")]).withColumn("bpe_text", F.lit(1)).withColumn("ids", F.lit(2))
    assert bpe.encode(df).columns == ["doc_id", "ids"]
    assert bpe.encode(df).first().ids
    assert bpe.decode(bpe.encode(df.limit(0))).count() == 0


def test_long_texts_go_part_by_part(reference, monkeypatch):
    """The ids do not depend on where texts, pieces or stores are cut."""
    rng = random.Random(3)
    long = " ".join("".join(rng.choice("etaonishrdé") for _ in range(rng.randrange(1, 14))) for _ in range(3000))
    many = [long, "short one", None, long[:500], "x" * 3000, "", long[1000:9000]]
    want = [reference.encode_ordinary(t or "") for t in many]
    for name, value in (("BATCH_BYTES", 700), ("MERGE_BYTES", 900), ("PART", 37), ("STORE_BYTES", 5000)):
        monkeypatch.setattr(bpe, name, value)
        own = bpe.Codec(bpe.RANKS, public_tokenizers.PATTERN)
        assert [x.tolist() for x in own.encode(many)] == want and [x.tolist() for x in own.encode(many)] == want
        assert own.held == sum(bpe.PIECE_BYTES + len(k) + len(v) for k, v in own.newer.items())


def test_memory_of_a_worker():
    """4 MB of words that no store has met stay below a stated peak, in a process of their own."""
    code = """
import random, resource
from helmline.llm import bpe
rng = random.Random(1)
own = bpe.codec(bpe.RANKS, bpe.public_tokenizers.PATTERN)
for _ in range(8):
    text = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(5000)) for _ in range(10)]
    own.encode(text)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    peak = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert peak < 330, peak
