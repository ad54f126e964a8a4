"""Each stage of the pipeline against a plain version, on the rows that the stage before it kept."""

import base64

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from helmline.llm import bpe, mixing, toxicity
from tests.llm.test_pii import expected
from tests.llm.test_simhash import least_reachable, plain_fingerprint


def test_stages(spark, sf_dir, tmp_path):
    docs, frames = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        frames.append((docs, docs := spark.read.parquet(str(tmp_path / name))))
    rows = [({r.doc_id: r for r in a.collect()}, {r.doc_id: r for r in b.collect()}) for a, b in frames]
    (all_docs, clean), (_, unique), (_, private), (_, drawn), (_, tokens) = rows
    assert all(b.columns == list(corpus_pipeline.COLUMNS) for _, b in frames[:-1])

    model = toxicity.train(frames[0][0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    ids = list(all_docs)
    scored = dict(zip(ids, toxicity.scores(model, [(all_docs[i].text or "").encode() for i in ids])))
    assert set(clean) == {i for i in ids if scored[i] < toxicity.THRESHOLD}

    ids = list(clean)
    prints = np.array([plain_fingerprint(clean[i].text) for i in ids], np.uint64)
    least = least_reachable(ids, lambda a, b: int(prints[a] ^ prints[b]).bit_count() <= 3)
    assert set(unique) == set(least.values())

    for i, r in private.items():
        before = unique[i].text
        assert (r.text == before) or expected(before) or "[IBAN]" in r.text or "[NATIONAL_ID]" in r.text
        assert not [s for s in expected(r.text) if s[2] == "email"] and r.n_chars == len(r.text)
    assert set(private) == set(unique)

    chance = {r.doc_id: r for r in mixing.probabilities(frames[3][0]).collect()}
    assert set(drawn) == {i for i, r in chance.items() if r.kept}

    with open(bpe.RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert set(tokens) == set(drawn)
    for i, r in tokens.items():
        assert list(r.ids) == library.encode_ordinary(drawn[i].text) and r.round_trip and r.n_tokens == len(r.ids)


def test_run_on_odd_rows(spark, tmp_path):
    from tests.llm.helpers import documents

    rows = [(1, None), (2, ""), (None, "no id"), (3, "me@you.org wrote"), (3, "me@you.org wrote"), (4, "x " * 300)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.round_trip for r in got)


def test_one_row_of_each_group_of_copies(spark):
    from tests.llm.helpers import documents

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    docs = documents(spark, [(5, a), (5, a), (7, a), (None, a), (9, b), (7, b), (None, c), (None, c), (8, None), (8, "")])
    kept = corpus_pipeline.near_copies_out(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(5, a), (7, b), (0, c), (8, "")])
