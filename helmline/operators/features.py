"""Row-local stage: everything a record says on its own, computed once.

Output holds no full text. Sentence rows stay nested, so the stage shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helmline.config import DEFAULT as CONFIG
from helmline.functions import text as T
from helmline.lexicon import DEFAULT as LEXICON
from helmline.sources.records import (
    failed_actions, is_operator_turn, path_targets, write_targets,
)

# Label of a sentence in precedence order: (marker group, label). Restatement comes after the first two.
SEGMENT_RULES = (
    ("reset", "handoff"),
    ("correction_tier1", "correction"),
    ("stop", "stop_condition"),
    ("scope", "scope_constraint"),
    ("negative", "negative_constraint"),
    ("positive", "positive_constraint"),
    ("meta", "meta_process"),
    ("new_task_line", "new_task"),
    ("referent", "referent_disambiguation"),
    ("reconstruction", "restart_reconstruction"),
    ("temporal", "temporal_disambiguation"),
    ("evidence", "new_evidence"),
    ("forward", "forward_work"),
)
RESTATED = "restated_prior_state"

# The aggregate each label contributes to; anything else is OTHER.
BUCKETS = {
    "FORWARD": ("forward_work", "new_task", "new_evidence"),
    "CONTROL": ("scope_constraint", "negative_constraint", "positive_constraint", "stop_condition",
                "meta_process", "handoff"),
    "RECOVERY": ("correction", "referent_disambiguation", "temporal_disambiguation",
                 "namespace_disambiguation", "restart_reconstruction", "handoff_after_failure"),
    "RESTATE": (RESTATED,),
}

POINTER_RULES = ("task", "file", "namespace", "operation", "quote", "alias")
OBLIGATION_KINDS = ("stop", "scope", "negative", "positive")


def bucket_of(label: Column) -> Column:
    out = F.when(F.lit(False), "")
    for bucket, names in BUCKETS.items():
        out = out.when(label.isin(*names), bucket)
    return out.otherwise("OTHER")


def segment_label(s: Column, lex=LEXICON, restated: Column | None = None) -> Column:
    """First matching rule. `restated` enters after reset and correction."""
    out = F.when(F.lit(False), "")
    if restated is None:
        out = F.when(~lex.match_any([g for g, _ in SEGMENT_RULES], s), "other")
    for i, (group, label) in enumerate(SEGMENT_RULES):
        if i == 2 and restated is not None:
            out = out.when(restated, RESTATED)
        out = out.when(lex.match(group, s), label)
    return out.otherwise("other")


def is_bulk(text: Column, lex=LEXICON) -> Column:
    count = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return count > int(lex.param("bulk_paste_lines", 40))


def pointer(text: Column, lex=LEXICON) -> Column:
    """First hit in the fixed order of reference kinds: struct<type,text,chars>; NULL when none."""
    hits = [(k, F.nullif(lex.find(f"pointer_{k}", text), F.lit(""))) for k in POINTER_RULES]
    return F.coalesce(*[
        F.when(h.isNotNull(),
               F.struct(F.lit(k).alias("type"), h.alias("text"), F.length(h).alias("chars")))
        for k, h in hits
    ])


def named_paths(text: Column, lex=LEXICON) -> Column:
    return F.array_distinct(lex.find_all("pointer_file", text))


def snippet(text: Column, privacy) -> Column:
    if privacy.store_text:
        return text
    if not privacy.store_snippets or privacy.snippet_chars == 0:
        return F.lit("")
    return F.substring(text, 1, privacy.snippet_chars)


def candidates(sents: Column, lex=LEXICON) -> Column:
    """Marker-carrying sentences with their structural evidence, kept and rejected alike.

    array<struct<pos,start,end,text,key,kind,content_key,subject,second_person,contained,
    code_density,describes>>. Built in two passes so that shared values are evaluated once.
    """
    floor = int(lex.param("min_obligation_chars", 8))

    def probe(s):
        t = s["text"]
        at = {k: lex.position(k, t) for k in OBLIGATION_KINDS}
        kind = F.coalesce(*[F.when(p > 0, k) for k, p in at.items()])
        first = F.least(*[F.nullif(p, F.lit(0)) for p in at.values()])
        return F.struct(
            s["pos"].alias("pos"), s["start"].alias("start"), s["end"].alias("end"),
            t.alias("text"), T.normalize(t).alias("key"), kind.alias("kind"),
            first.alias("marker_at"), s["contained"].alias("contained"),
        )

    def describe(p):
        t = p["text"]
        return F.struct(
            p["pos"].alias("pos"), p["start"].alias("start"), p["end"].alias("end"),
            t.alias("text"), p["key"].alias("key"), p["kind"].alias("kind"),
            T.content_key(t).alias("content_key"),
            T.has_subject(F.substring(t, F.lit(1), p["marker_at"] - 1)).alias("subject"),
            lex.match("second_person", t).alias("second_person"),
            p["contained"].alias("contained"),
            T.code_density(t, lex.java.get("code_span", r"\b\B"),
                           lex.java.get("path_token", r"\b\B")).alias("code_density"),
        )

    def verdict(d):
        return d.withField("describes", describes(d["subject"], d["second_person"],
                                                  d["contained"], lex))

    marked = F.filter(
        F.transform(F.filter(sents, lambda s: lex.match_any(OBLIGATION_KINDS, s["text"])), probe),
        lambda p: p["kind"].isNotNull() & (F.octet_length(p["key"]) >= floor)
        & ~lex.match("release", p["text"]),
    )
    return F.transform(F.transform(marked, describe), verdict)


def describes(subject: Column, second_person: Column, contained: Column, lex=LEXICON) -> Column:
    """A sentence describes when it was delivered (contained), or has a subject and no addressee."""
    out = contained if lex.on("contained") else F.lit(False)
    if not lex.on("subject_before_marker"):
        return out
    addressed = second_person if lex.on("second_person") else F.lit(False)
    return out | (subject & ~addressed)


def correction_key(kept: Column, ptr: Column) -> Column:
    """Key of the first kept stop or scope obligation, else the normalized reference, else empty."""
    bound = F.filter(kept, lambda c: c["kind"].isin("stop", "scope"))
    return F.coalesce(
        F.get(F.transform(bound, lambda c: c["key"]), 0), T.normalize(ptr["text"]), F.lit("")
    )


def record_features(records: DataFrame, lex=LEXICON, config=CONFIG) -> DataFrame:
    """Observations and classifications that need no other record."""
    op = is_operator_turn(F.col("speaker_class"), F.col("sidechain"), F.col("input_mode"))
    agent = F.col("speaker_class") == "agent"
    t = F.col("text")
    base = records.select(
        "stream_id", "seq", "turn_id", "ts", "speaker", "speaker_class", "source", "text",
        F.coalesce("input_mode", F.lit("")).alias("input_mode"),
        F.element_at("metadata", "stream_name").alias("stream_name"),
        op.alias("is_op"), (agent & ~op).alias("is_agent"),
        (F.coalesce("input_mode", F.lit("")) == "interrupt").alias("is_interrupt"),
        T.n_bytes(t).alias("bytes"), T.n_chars(t).alias("chars"), T.n_words(t).alias("words"),
        T.n_lines(t).alias("lines"),
        F.when(F.col("actions").isNull(), 0).otherwise(F.size("actions")).alias("action_count"),
        failed_actions(F.col("actions")).alias("failed_actions"),
        path_targets(F.col("actions")).alias("path_targets"),
        write_targets(F.col("actions")).alias("write_paths"),
        snippet(t, config.privacy).alias("snippet"),
        F.when(op, T.sentences(t)).alias("sents"),
        F.when(op, is_bulk(t, lex)).alias("bulk"),
    )
    op, agent = F.col("is_op"), F.col("is_agent")
    first = T.first_sentence(t)
    plain = op & ~F.col("bulk")
    with_marks = base.select(
        "*",
        F.when(op, T.quoted_chars(t)).alias("quoted_chars"),
        F.when(op, T.token_set(t)).alias("tokens"),
        F.when(op, F.filter(
            F.transform(T.lines(t), lambda ln: F.struct(
                T.normalize(ln).alias("norm"), F.length(ln).alias("chars"))),
            lambda x: F.octet_length(x["norm"]) >= 8)).alias("line_norms"),
        F.when(op, candidates(F.col("sents"), lex)).alias("cands"),
        F.when(op, pointer(t, lex)).alias("pointer"),
        F.when(op, lex.match("reset", t)).alias("reset"),
        F.when(op, plain & lex.match("stop", t)).alias("stop"),
        F.when(op, lex.match("acceptance", first)).alias("acceptance"),
        F.when(op, lex.match("continuation", first)).alias("continuation"),
        F.when(plain, T.lower(F.nullif(lex.find("correction_tier1", t), F.lit("")))).alias("tier1"),
        F.when(plain, T.lower(F.nullif(lex.find("correction_tier2", t), F.lit("")))).alias("tier2"),
        F.when(op, named_paths(t, lex)).alias("named_paths"),
        (agent & lex.match("expansion_task", t)).cast("int").alias("exp_task"),
        (agent & lex.match("expansion_validation", t)).cast("int").alias("exp_validation"),
        (agent & lex.match("expansion_constraint", t)).cast("int").alias("exp_constraint"),
        (agent & (F.col("action_count") == 0) & lex.match("expansion_scope", t)).cast("int")
        .alias("exp_scope"),
        (agent & lex.match("repair_verb", t)).alias("claim"),
    )
    releases = F.when(plain, F.filter(
        F.transform(F.col("sents"), lambda s: F.struct(
            s["pos"].alias("pos"), s["text"].alias("text"),
            lex.find("release", s["text"]).alias("marker"))),
        lambda r: r["marker"] != ""))
    segs = F.when(op, F.transform(
        F.filter(F.col("sents"), lambda s: s["text"] != ""),
        lambda s: F.struct(
            s["pos"].alias("pos"), s["start"].alias("start"), s["end"].alias("end"),
            s["chars"].alias("chars"), T.normalize(s["text"]).alias("norm"),
            segment_label(s["text"], lex).alias("label"))))
    kept = F.filter(F.col("cands"), lambda c: ~c["describes"])
    return with_marks.select(
        "*", releases.alias("release_sents"), segs.alias("segs"), kept.alias("kept"),
        F.when(op, correction_key(kept, F.col("pointer"))).alias("target_key"),
        F.when(op, F.coalesce(F.col("pointer.type"), F.lit("unknown"))).alias("target_type"),
    ).drop("sents", "text")
