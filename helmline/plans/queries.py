"""Registered queries: one per operator, over the given tables."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helmline.config import DEFAULT as CONFIG
from helmline.config import Privacy
from helmline.functions import text as T
from helmline.functions.ordered import framed, layout
from helmline.lexicon import BASELINE_MARKERS
from helmline.lexicon import DEFAULT as LEX
from helmline.operators import corpus as C
from helmline.operators import episodes as E
from helmline.operators import events as EV
from helmline.operators import features as FE
from helmline.operators import labels as L
from helmline.operators import measures as M
from helmline.operators import obligations as O
from helmline.operators import pointers as P
from helmline.operators import semantic as S
from helmline.operators import summary as SU
from helmline.operators import turns as W
from helmline.operators import units as U
from helmline.plans import formats
from helmline.plans.pipeline import _analyze, fitting_layout, turn_table
from helmline.plans.stage import folder, stage
from helmline.plans.transcripts import seeded
from helmline.sources import linking
from helmline.sources.records import read_conversations, write_targets
from helmline.sources.tables import read_table

KEY = ["stream_id", "turn_index"]
_open: dict = {}


class Corpus:
    """The seeded transcripts of one folder, with shared stages built at first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def texts(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.dir}/{name}.parquet")

    @cached_property
    def records(self):
        return seeded(self.spark, self.dir)

    @cached_property
    def feats(self):
        return stage(FE.record_features(self.records), "features")

    @cached_property
    def shape(self):
        return fitting_layout(self.feats)

    def shaped(self, build):
        with layout(self.shape):
            return build()

    @cached_property
    def seqd(self):
        return self.shaped(lambda: stage(W.sequence(self.feats), "sequenced"))

    @cached_property
    def turns(self):
        return self.shaped(lambda: stage(turn_table(self.seqd), "turns"))

    @cached_property
    def occ(self):
        return stage(O.occurrences(self.turns), "occurrences")

    @cached_property
    def intro(self):
        return stage(O.introductions(self.occ), "introductions")

    @cached_property
    def no_claims(self):
        return self.spark.createDataFrame([], O.CLAIMS)

    @cached_property
    def plain_ledger(self):
        """Ledger as if nothing was ever released."""
        return self.shaped(lambda: stage(O.ledger(self.occ, self.no_claims), "ledger"))

    @cached_property
    def stated(self):
        return O.statements(self.occ, self.plain_ledger)

    @cached_property
    def fixed(self):
        """Turns with corrections decided on that ledger."""
        return stage(E.decide_corrections(self.turns, self.stated), "corrections")

    @cached_property
    def marked(self):
        return self.shaped(lambda: stage(E.with_stretches(
            self.fixed, E.cycles(self.seqd), E.write_overlap(self.seqd)), "stretches"))

    @cached_property
    def a(self):
        return self.shaped(lambda: _analyze(self.feats, LEX, CONFIG))

    @cached_property
    def shares(self):
        b = self.turns.select(
            "stream_id", "epoch_before", "turn_index", "seq", "chars",
            *[F.col(f"b.{n}").alias(n) for n in ("forward", "recovery", "restate", "other")],
            (F.col("b.control") + F.col("b.handoff")).alias("control"))
        return self.shaped(lambda: W.window_shares(b))

    @cached_property
    def label_table(self):
        """Two judgements per document of the labels table, as labeling passes."""
        c = F.col
        base = self.table("labels").select("doc_id", "quality", "toxic")
        rec = F.concat(F.lit("d"), c("doc_id").cast("string"))

        def one(labeler, value):
            return base.select(
                F.concat(F.lit("s"), (c("doc_id") % 7).cast("string")).alias("session"),
                rec.alias("record"), F.lit("obligation").alias("family"),
                F.lit(0).cast("long").alias("start"), (c("doc_id") % 5 * 3).cast("long").alias("end"),
                F.when(c("doc_id") % 13 == 0, "unlabelable").when(value, "directive")
                .otherwise("description").alias("label"),
                F.lit(labeler).alias("labeler"),
                F.when(c("doc_id") % 26 == 0, "").otherwise("why").alias("note"),
                (c("doc_id") * 2 + int(labeler == "b")).cast("long").alias("li"))
        return one("a", c("quality") == 1).unionByName(one("b", c("toxic") == 0))

    @cached_property
    def prediction_table(self):
        """Predictions with shifted spans; those of a third of the documents lie beyond any label."""
        c = F.col
        d = self.table("documents").withColumn("beyond", F.when(c("doc_id") % 3 == 0, 1000).otherwise(0).cast("long"))
        return d.select(
            F.concat(F.lit("s"), (c("doc_id") % 7).cast("string")).alias("session"),
            F.concat(F.lit("d"), c("doc_id").cast("string")).alias("record"),
            F.lit("obligation").alias("family"), ((c("doc_id") % 2).cast("long") + c("beyond")).alias("start"),
            ((c("doc_id") % 5 * 3 + 2 * (c("doc_id") % 4) - 2).cast("long") + 2 * c("beyond")).alias("end"),
            F.when(c("n_chars") % 2 == 0, "directive").otherwise("description").alias("value"),
            c("doc_id").alias("pi"),
            F.create_map(
                F.lit("even"), F.when(c("n_chars") % 2 == 0, "directive").otherwise("description"),
                F.lit("long"), F.when(c("n_chars") > 900, "directive").otherwise("description"))
            .alias("detail"))

    @cached_property
    def scored_pairs(self):
        ones = self.label_table.where("labeler = 'a'")
        return L.align(ones, self.prediction_table)


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _open:
        _open[key] = Corpus(spark, sf_dir)
    return _open[key]


def forget() -> None:
    """Drop shared stages, so that the next query starts cold."""
    _open.clear()


def big(col):
    return F.col(col).cast("long").alias(col) if isinstance(col, str) else col.cast("long")


def rounded(col, name):
    return F.round(col, 10).alias(name)


REGISTRY: dict = {}


def query(name: str, shaped: bool = False):
    """Register a query. `shaped` queries work on the staged transcripts, whose size is known."""
    def add(fn):
        def run(spark, sf_dir):
            k = corpus(spark, sf_dir)
            return k.shaped(lambda: fn(k)) if shaped else fn(k)

        REGISTRY[name] = run
        return fn
    return add


# ---- sources -----------------------------------------------------------------------------------
def _reader(name):
    @query(name)
    def _(k):
        return formats.records(k.spark, k.table("conversations"), name)


for _name in formats.READERS:
    _reader(_name)


@query("t04c_read_conversations")
def _(k):
    d = read_conversations(k.table("conversations"))
    return d.select("stream_id", "turn_id", "seq", "speaker_class", F.md5("text").alias("text_md5"))


@query("t05_event_routing")
def _(k):
    d = k.table("events").select(F.when(F.col("event_type") == "click", "repair_opened")
                                 .when(F.col("event_type") == "view", "repair_expansion_candidate")
                                 .when(F.col("event_type") == "error", "obligation_repeated")
                                 .when(F.col("event_type") == "purchase", "metrics_computed")
                                 .otherwise("record_observed").alias("kind"))
    return d.groupBy("kind", EV.file_for(F.col("kind")).alias("file")).agg(F.count("*").alias("n"))


@query("t06_event_store")
def _(k):
    """The events table as a log: two writes of other streams, then a third of the streams replaced, read back."""
    c = F.col
    kind = F.when(c("event_type") == "click", "repair_opened").when(c("event_type") == "view", "obligation_introduced").when(
        c("event_type") == "error", "epoch_advanced").when(c("event_type") == "purchase", "stop_candidate").otherwise("record_observed")
    d = k.table("events").select(
        F.concat(F.lit("u"), c("user_id").cast("string")).alias("stream_id"), big(c("event_id")).alias("seq"), F.lit(1).alias("emit_rank"),
        F.lit(0).alias("sub"), F.lit("").alias("item"), F.lit(0).alias("epoch"), kind.alias("kind"), F.lit("observed").alias("class"),
        c("props").alias("payload"), "user_id")
    root = f"{folder(k.spark)}/helmline-log-{uuid.uuid4().hex}"
    EV.write_events(d.where("user_id % 2 = 0 or user_id is null").drop("user_id"), root, buckets=8)
    EV.write_events(d.where("user_id % 2 <> 0").drop("user_id"), root)
    EV.write_events(d.where("user_id % 3 = 0").withColumn("payload", F.upper("payload")).drop("user_id"), root, force=True)
    return EV.read_events(k.spark, root).select("stream_id", "seq", "kind", "file", "payload")


@query("t07_line_provenance")
def _(k):
    d = linking.lines_with_offsets(k.texts("documents").select(
        F.col("doc_id").cast("string").alias("path"), F.col("text").alias("value")))
    return d.select("path", big("offset"), "record_sha256")


@query("t09_timeline", shaped=True)
def _(k):
    s = k.shares.select(
        "stream_id", "seq", F.col("epoch_before").alias("epoch"), F.lit("FLOW").alias("regime"),
        F.lit("flow").alias("regime_rule"), F.col("chars").alias("user_chars"),
        F.lit(None).cast("double").alias("baseline_chars"),
        F.lit(None).cast("double").alias("serialization_inflation"), "forward_work_share",
        "control_plane_burden", F.lit(0).alias("unresolved_obligations"),
        F.lit(0).alias("repeated_obligations"), F.lit(0).alias("repair_depth"),
        F.lit(0).alias("repair_chars"), F.lit(None).cast("double").alias("dereference"),
        F.lit("").alias("pollution_status"))
    return SU.timeline(s)


@query("t10_label_check")
def _(k):
    d = L.checked(k.label_table.withColumn("family", F.when(F.col("li") % 17 == 0, "other").otherwise(
        F.col("family"))))
    return d.groupBy(F.coalesce("problem", F.lit("ok")).alias("problem")).agg(F.count("*").alias("n"))


# ---- row-local ---------------------------------------------------------------------------------
@query("f01_operator_turns")
def _(k):
    return k.records.select("stream_id", "seq", FE.is_operator_turn(
        F.col("speaker_class"), F.col("sidechain"), F.col("input_mode")).alias("is_op"))


@query("f02_size_counts")
def _(k):
    t = F.col("text")
    return k.texts("documents").select(
        "doc_id", big(T.n_bytes(t)).alias("bytes"), big(T.n_chars(t)).alias("chars"),
        big(T.n_words(t)).alias("words"), big(T.n_lines(t)).alias("lines"))


@query("f03_normalize")
def _(k):
    return k.texts("documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("norm_md5"))


@query("f04_tokens")
def _(k):
    t = T.tokens(F.col("text"))
    return k.texts("documents").select(
        "doc_id", big(F.size(t)).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


def _neighbours(k):
    d = k.table("conversations").select("conv_id", "turn", T.token_set(F.col("text")).alias("have"))
    prev = d.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("have").alias("want"))
    return d.join(prev, ["conv_id", "turn"])


@query("f05_jaccard")
def _(k):
    return _neighbours(k).select("conv_id", "turn", rounded(T.jaccard(F.col("have"), F.col("want")), "jaccard"))


@query("f06_token_coverage")
def _(k):
    return _neighbours(k).select(
        "conv_id", "turn", rounded(T.token_coverage(F.col("have"), F.col("want")), "cover"),
        big(T.shared_tokens(F.col("have"), F.col("want"))).alias("shared"))


@query("f07_quoted_chars")
def _(k):
    return k.records.select("stream_id", "seq", big(T.quoted_chars(F.col("text"))).alias("quoted_chars"))


@query("f08_sentences")
def _(k):
    d = k.texts("documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return d.select("doc_id", big("s.pos").alias("pos"), big("s.start").alias("start"),
                    big("s.end").alias("end"), big("s.chars").alias("chars"))


@query("f09_contained")
def _(k):
    d = k.records.select("stream_id", "seq", F.explode(T.sentences(F.col("text"))).alias("s"))
    return d.where("s.text <> ''").groupBy("stream_id", "seq").agg(
        F.count_if("s.contained").alias("contained"), F.count("*").alias("sentences"))


@query("f10_code_density")
def _(k):
    t = F.col("text")
    return k.records.select("stream_id", "seq", rounded(T.code_density(
        t, LEX.java["code_span"], LEX.java["path_token"]), "code_density"))


def _paths(k):
    p = F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1)
    n = F.col("page_id") % 6
    path = (F.when(n == 0, F.concat(p, F.lit("//x"))).when(n == 1, F.concat(p, F.lit("/./x/")))
            .when(n == 2, F.concat(p, F.lit("/q/../x"))).when(n == 3, F.lit("rel/./a.py"))
            .when(n == 4, F.lit("/en")).otherwise(p))
    return k.table("pages").select("page_id", path.alias("path"), F.lit("/en/").alias("root"))


@query("f11_normalize_target")
def _(k):
    return _paths(k).select("page_id", T.normalize_target(F.col("root"), F.col("path")).alias("target"))


@query("f12_write_targets")
def _(k):
    from helmline.sources.records import failed_actions, path_targets

    a = F.col("actions")
    return k.records.select(
        "stream_id", "seq", F.array_join(write_targets(a), ",").alias("writes"),
        F.array_join(path_targets(a), ",").alias("paths"), big(failed_actions(a)).alias("failed"))


@query("f13_marker_groups")
def _(k):
    d = k.records.select(F.explode(T.sentences(F.col("text"))).alias("s")).where("s.text <> ''")
    s = F.col("s.text")
    hits = d.agg(*[F.count_if(LEX.match(g, s)).alias(g) for g in BASELINE_MARKERS])
    return hits.unpivot([], list(BASELINE_MARKERS), "grp", "n")


def _op_sentences(k):
    return k.turns.select("stream_id", "seq", F.explode("segs").alias("s"))


@query("f16_segment_labels", shaped=True)
def _(k):
    return _op_sentences(k).select("stream_id", "seq", big("s.pos").alias("pos"), F.col("s.label").alias("label"))


@query("f17_label_buckets", shaped=True)
def _(k):
    return _op_sentences(k).groupBy(F.col("s.label").alias("label"), FE.bucket_of(F.col("s.label")).alias("bucket")
                                    ).agg(F.count("*").alias("n"), F.sum("s.chars").alias("chars"))


def _cands(k):
    return k.turns.select("stream_id", "seq", F.explode("cands").alias("c"))


@query("f18_obligation_candidates", shaped=True)
def _(k):
    return _cands(k).select("stream_id", "seq", big("c.pos").alias("pos"), "c.kind", F.md5("c.key").alias("key_md5"))


@query("f19_directive_tests", shaped=True)
def _(k):
    return _cands(k).select("stream_id", "seq", big("c.pos").alias("pos"), "c.subject", "c.second_person",
                            "c.contained", "c.describes")


@query("f20_content_key", shaped=True)
def _(k):
    return _cands(k).select("stream_id", "seq", big("c.pos").alias("pos"),
                            F.replace("c.content_key", F.lit("\x00"), F.lit("!")).alias("content_key"))


@query("f21_pointer", shaped=True)
def _(k):
    return k.turns.where("pointer is not null").select(
        "stream_id", "seq", F.col("pointer.type").alias("ptype"), F.col("pointer.text").alias("ptext"),
        big("pointer.chars").alias("pchars"))


@query("f22_named_paths", shaped=True)
def _(k):
    return k.turns.select("stream_id", "seq", F.array_join("named_paths", ",").alias("paths"))


@query("f23_acceptance", shaped=True)
def _(k):
    return k.turns.select("stream_id", "seq", "acceptance", "continuation")


@query("f24_bulk_guard")
def _(k):
    t = F.col("text")
    return k.texts("documents").select(
        "doc_id", FE.is_bulk(t).alias("bulk"), (~FE.is_bulk(t) & LEX.match("stop", t)).alias("stop"),
        F.when(~FE.is_bulk(t), F.lower(LEX.find("correction_tier1", t))).alias("tier1"))


@query("f25_agent_signals", shaped=True)
def _(k):
    return k.feats.where("is_agent").select(
        "stream_id", "seq", *[big(n) for n in ("exp_task", "exp_validation", "exp_constraint", "exp_scope")],
        "claim")


@query("f26_snippet")
def _(k):
    return k.table("documents").select("doc_id", FE.snippet(F.col("text"), Privacy()).alias("snippet"))


@query("f27_correction_key", shaped=True)
def _(k):
    return k.turns.select("stream_id", "seq", "target_type", F.md5("target_key").alias("key_md5"))


@query("f28_ratio_median")
def _(k):
    d = k.table("lineitem").groupBy("l_suppkey").agg(
        F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("q"),
        F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_tax") > 0.07).alias("t"))
    return d.select("l_suppkey", rounded(W.median_of(F.col("q")), "med"), rounded(W.ratio(F.col("a"), F.col("t")), "ratio"))


@query("f29_event_id")
def _(k):
    e = k.table("events")
    return e.select("event_id", EV.event_id(
        F.col("user_id").cast("string"), F.col("event_id"), F.col("event_type"), F.col("event_id") % 3).alias("id"))


@query("f30_bands")
def _(k):
    c = F.col
    d = k.table("lineitem").select(
        F.when(c("l_linenumber") > 1, c("l_quantity") / 6).alias("serialization_inflation"),
        F.when(c("l_quantity") > 3, c("l_discount") * 10).alias("control_plane_burden"),
        F.when(c("l_quantity") > 5, c("l_tax") * 12).alias("forward_work_share"),
        F.when(c("l_quantity") < 40, c("l_tax") * 14).alias("dereference"),
        (c("l_linenumber") - 1).alias("repair_depth"))
    names = [f"band_{m}" for m in M.TREND_METRICS]
    return M.bands(d).groupBy(*names).agg(F.count("*").alias("n"))


@query("f31_pollution")
def _(k):
    c = F.col
    p = M.pollution(
        F.when(c("l_linenumber") <= 4, c("l_returnflag") == "A"), F.floor(c("l_tax") * 100 / 3),
        c("l_linestatus") == "O", F.floor(c("l_discount") * 40), c("l_quantity") > 20)
    return k.table("lineitem").select(p.alias("p")).groupBy("p.status", "p.premise").agg(F.count("*").alias("n"))


def _regime_inputs(k):
    c = F.col
    return k.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        (c("l_partkey") % 19 == 0).alias("reset"), (c("l_returnflag") == "R").alias("repair_open"),
        F.when(c("l_returnflag") == "R", c("l_suppkey") % 4).alias("open_depth"),
        F.when(c("l_returnflag") == "R", c("l_partkey") % 900).alias("open_chars"),
        F.when(c("l_quantity") > 10, c("l_quantity") * 4).alias("baseline_chars"),
        F.when(c("l_tax") > 0.01, c("l_quantity") / 12).alias("serialization_inflation"),
        F.when(c("l_discount") > 0, c("l_discount") * 8).alias("forward_work_share"),
        (c("l_suppkey") % 3).alias("repeated_obligations"),
        (c("l_partkey") % 7 % 3).alias("recent_dereference_misses"),
        (c("l_partkey") % 5 % 2).alias("recent_corrections"),
        (c("l_suppkey") % 5 % 2).alias("recent_interrupts"),
        (c("l_partkey") % 2).alias("recent_obligation_repeats"))


@query("f32_regime")
def _(k):
    return M.regime(_regime_inputs(k)).groupBy("regime", "regime_rule").agg(F.count("*").alias("n"))


@query("f33_duration_magnification")
def _(k):
    c = F.col
    e = k.table("events").select("event_id", "user_id", "ts", "value")
    nxt = e.select((c("event_id") - 7).alias("event_id"), c("ts").alias("other_ts"), c("value").alias("other"))
    d = e.join(nxt, "event_id")
    flip = F.when(c("event_id") % 2 == 0, W.elapsed(c("ts"), c("other_ts"))).otherwise(
        W.elapsed(c("other_ts"), c("ts")))
    return d.select("event_id", rounded(flip, "seconds"),
                    rounded(M.magnification(c("value"), F.floor(c("other") - 5)), "magnification"))


# ---- windows -----------------------------------------------------------------------------------
@query("w01_turn_index", shaped=True)
def _(k):
    return k.seqd.select("stream_id", "seq", "turn_index")


@query("w02_epoch", shaped=True)
def _(k):
    return k.seqd.select("stream_id", "seq", "epoch_before", "epoch")


@query("w03_rolling_epoch", shaped=True)
def _(k):
    return k.turns.select("stream_id", "turn_index", "opens_epoch", "first_before")


@query("w04_gaps", shaped=True)
def _(k):
    return k.seqd.select("stream_id", "seq", rounded(F.col("gap_seconds_previous"), "gap_previous"),
                         rounded(F.col("gap_seconds_previous_human"), "gap_human"))


@query("w04_event_gaps")
def _(k):
    e = k.table("events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("stream_id"),
        F.col("event_id").alias("seq"), "ts", (F.col("event_type") == "click").alias("is_op"),
        F.lit(False).alias("is_agent"), F.lit(False).alias("reset"))
    return W.sequence(e).select("stream_id", "seq", rounded(F.col("gap_seconds_previous"), "gap_previous"),
                                rounded(F.col("gap_seconds_previous_human"), "gap_human"))


@query("w05_repeat_chars", shaped=True)
def _(k):
    return W.repeated_lines(k.turns).select("stream_id", "turn_index", big("repeat_chars"))


@query("w06_restated_sentences", shaped=True)
def _(k):
    d = W.restated_sentences(k.turns)
    return d.select("stream_id", "turn_index", F.array_join(F.array_sort("restated"), ",").alias("restated"))


@query("w07_overlap_previous", shaped=True)
def _(k):
    return W.lexical_overlap(k.turns).select("stream_id", "turn_index",
                                             rounded(F.col("lexical_overlap_previous"), "overlap"))


@query("w08_overlap_window", shaped=True)
def _(k):
    return W.lexical_overlap(k.turns).select("stream_id", "turn_index",
                                             rounded(F.col("lexical_overlap_window"), "overlap"))


@query("w09_window_shares", shaped=True)
def _(k):
    return k.shares.select(
        "stream_id", "seq", "turn_index",
        *[big(f"{n}_chars") for n in ("forward", "control", "recovery", "restate", "other")],
        *[rounded(F.col(n), n) for n in ("forward_work_share", "control_plane_burden", "restate_burden")])


def _baseline(k):
    t = k.turns.select("stream_id", "epoch_before", "turn_index", "seq", "chars", "tier1", "pointer")
    own = t.where("tier1 is null and pointer is null").select(
        "stream_id", "epoch_before", "turn_index", F.lit(True).alias("late"),
        F.col("turn_index").alias("ord"), "chars")
    # A reference joins two turns later, when that turn is in the same epoch.
    back = t.where("tier1 is null and pointer is not null").select(
        "stream_id", "epoch_before", (F.col("turn_index") + 2).alias("turn_index"),
        F.col("turn_index").alias("ord"), "chars")
    back = back.join(t.select("stream_id", "epoch_before", "turn_index"),
                     ["stream_id", "epoch_before", "turn_index"], "left_semi").withColumn("late", F.lit(False))
    return M.control_baseline(t.drop("tier1", "pointer"), own.unionByName(back))


@query("w10_control_baseline", shaped=True)
def _(k):
    return _baseline(k).select("stream_id", "turn_index", rounded(F.col("baseline_chars"), "baseline_chars"),
                               big("baseline_turns"))


@query("w11_serialization_inflation", shaped=True)
def _(k):
    return _baseline(k).select("stream_id", "turn_index", rounded(F.col("serialization_inflation"), "inflation"))


@query("w12_drift_counts", shaped=True)
def _(k):
    cyc = E.cycles(k.seqd).select(
        "stream_id", (F.col("turn_index") + 1).alias("turn_index"), F.col("interrupts").alias("cycle_interrupts_before"))
    over = E.write_overlap(k.seqd).select(
        "stream_id", (F.col("turn_index") + 1).alias("turn_index"), F.lit(1).alias("structural_before"))
    t = k.turns.select("stream_id", "epoch_before", "turn_index", "opens_epoch",
                       F.col("tier1").isNotNull().alias("is_correction"),
                       (F.col("tier2").isNotNull()).cast("int").alias("misses"),
                       (F.size("kept") > 0).alias("any_repeated"))
    d = M.drift_counts(t.join(cyc, KEY, "left").join(over, KEY, "left"))
    return d.select(*KEY, *[big(n) for n in ("recent_corrections", "recent_interrupts",
                                             "recent_dereference_misses", "recent_obligation_repeats")])


@query("w13_trends", shaped=True)
def _(k):
    d = k.shares.select(
        "stream_id", "turn_index", "seq", "forward_work_share", "control_plane_burden",
        F.when(F.col("turn_index") % 5 > 0, F.col("chars") / 80.0).alias("serialization_inflation"),
        F.lit(None).cast("double").alias("dereference"),
        (F.floor(F.col("turn_index") / 3) % 4).alias("repair_depth"))
    return M.trends(M.bands(d)).select("stream_id", "metric", "turn_index", "from_band", "to_band", "direction",
                                       big("turns_held"))


def _simple_regimes(k):
    name = F.when(F.col("reset"), "RESET").when(F.col("tier1").isNotNull(), "RECOVERY").when(
        F.col("chars") % 5 == 0, "DRIFT").otherwise("FLOW")
    return k.turns.select("stream_id", "turn_index", "seq", "ts", name.alias("regime"), F.lit("r").alias("regime_rule"))


@query("w14_regime_changes", shaped=True)
def _(k):
    return M.regime_changes(_simple_regimes(k)).select("stream_id", "seq", "from_regime", "to_regime")


@query("w15_last_agent", shaped=True)
def _(k):
    return k.seqd.select("stream_id", "seq", F.col("last_agent.seq").alias("last_agent_seq"))


@query("w16_write_overlap", shaped=True)
def _(k):
    return E.write_overlap(k.seqd).select(*KEY, "overlap_seq", F.array_join("overlap", ",").alias("overlap"))


@query("w17_latest_name", shaped=True)
def _(k):
    d = k.feats.withColumn("stream_name", F.when(F.col("seq") % 6 == 2, F.concat(F.lit("name-"), F.col("seq").cast("string"))))
    return SU.last_names(d)


# ---- joins -------------------------------------------------------------------------------------
def _calls(k):
    e = k.table("events")
    calls = e.where("event_type in ('click', 'view')").select(
        F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("pos"),
        (F.col("event_id") % 50).cast("string").alias("call_id"))
    results = e.where("event_type = 'error'").select(
        F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("pos"),
        (F.col("event_id") % 50).cast("string").alias("call_id"), (F.col("value") > 10).alias("is_error"))
    return calls, results


@query("j01_failed_calls")
def _(k):
    return linking.mark_failed(*_calls(k)).groupBy("path").agg(
        F.count_if("failed").alias("failed"), F.count("*").alias("calls"))


@query("j02_structured_answers")
def _(k):
    calls, results = _calls(k)
    asks = calls.where("cast(call_id as int) % 3 = 0").select("path", "call_id", F.lit("ask").alias("tool"))
    ans = results.select("path", "pos", "call_id", F.create_map(
        F.concat(F.lit("q"), F.col("pos") % 7), F.lit("yes"), F.lit("q0x"), F.col("call_id")).alias("answers"),
        F.array(F.lit("note b"), F.lit("note a")).alias("notes"))
    return linking.answers(ans, asks, "ask").select("path", "pos", "text")


@query("j03_obligation_repeats", shaped=True)
def _(k):
    return k.stated.select("stream_id", "seq", big("pos"), "event", big("repeat_count"), "stood_before")


@query("j04_near_repeats", shaped=True)
def _(k):
    return O.near_repeats(k.occ, k.intro, k.plain_ledger).select(
        "stream_id", "seq", F.md5("key").alias("key_md5"), F.md5("prior_key").alias("prior_md5"), rounded(F.col("jaccard"), "jaccard"))


@query("j05_release_pairs", shaped=True)
def _(k):
    return O.release_pairs(k.turns, k.intro).select(
        "stream_id", "seq", big("pos"), F.md5("key").alias("key_md5"), big("shared"), rounded(F.col("cover"), "cover"))


def _completions(k):
    c = F.col
    return k.table("conversations").select(
        F.concat(F.lit("j"), (c("conv_id") * 10 + c("turn")).cast("string")).alias("job_id"),
        F.concat(F.lit("s-"), (c("conv_id") % 50).cast("string")).alias("stream_id"),
        (c("turn") + 1).alias("source_seq"), F.md5(c("role")).alias("input_hash"),
        F.when(c("turn") % 4 == 3, "").otherwise("model").alias("classifier"), F.lit("1").alias("classifier_version"),
        F.when(c("conv_id") % 5 == 0, "old").otherwise("h1").alias("classifier_hash"),
        F.element_at(F.array(*[F.lit(x) for x in ("completed", "completed", "timed_out", "canceled", "broken")]),
                     (c("conv_id") % 5 + 1).cast("int")).alias("status"),
        F.md5("text").alias("result"), (F.length("text") - 30).cast("long").alias("latency_ms"))


@query("j06_selected_completions")
def _(k):
    asked = _completions(k).select("stream_id", F.col("source_seq").alias("seq"), "input_hash").distinct()
    good, bad = S.select_completions(asked, _completions(k), ("model", "1", "h1"))
    return good.select("stream_id", "seq", "job_id", F.lit("selected").alias("what")).unionByName(
        bad.select("stream_id", "seq", F.lit("").alias("job_id"), F.col("problem").alias("what")))


@query("j07_alignment")
def _(k):
    return k.scored_pairs.select("session", "record", "label", "value", "overlap")


@query("j08_dedupe")
def _(k):
    d = k.table("documents").select("doc_id", "source", F.sha2("text", 256).alias("sha256"))
    return C.drop_sealed(d.where("source <> 'src0'"), d.where("source = 'src0'")).select("doc_id", "sha256")


def _sessions(k):
    return k.table("documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("project"), "doc_id")


@query("j09_prior_split")
def _(k):
    d = _sessions(k)
    prior = d.where("doc_id % 4 = 0").select("id", "project", F.when(F.col("doc_id") % 8 == 0, "dev").otherwise(
        "holdout").alias("split"))
    renamed = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("x"), F.col("id"))).otherwise(F.col("id"))
    return C.assign_split(d.select(renamed.alias("id"), "project"), prior)


@query("j10_pointer_outcomes", shaped=True)
def _(k):
    return P.outcomes(k.marked).select("stream_id", "seq", "pointer_type", "outcome", "evidence", "settled_turn")


@query("j11_verified_repairs", shaped=True)
def _(k):
    return E.verified_repairs(k.fixed, k.seqd).select(*KEY, "seq", "target_repaired", big("new_scope"))


@query("j12_broken_seals")
def _(k):
    d = k.table("documents")
    moved = F.when(F.col("doc_id") % 9 == 0, "moved-d").otherwise("d")
    files = d.select("doc_id", F.concat(moved, F.col("doc_id").cast("string")).alias("id"), F.sha2("text", 256).alias("sha256"))
    sealed = d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.sha2(F.when(
        F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return C.broken_seals(sealed, files)


# ---- aggregations ------------------------------------------------------------------------------
@query("a01_bucket_chars", shaped=True)
def _(k):
    return k.turns.select("stream_id", "seq", *[big(f"b.{n}").alias(n) for n in (
        "forward", "control", "recovery", "restate", "other", "handoff")])


def _surface(k, led, intro):
    from helmline.functions.ordered import TURN_BLOCK, Run, block_of, running

    none = k.occ.select(*O.EPOCH, "identity", "turn_index").limit(0)
    deltas = O.surface_deltas(led, none)
    med = O.standing_medians(led, intro).withColumn("m", F.struct("median_index"))
    keys = [*O.EPOCH, "turn_index"]
    t = k.turns.select(*keys, "seq").join(deltas, keys, "left").join(med.select(*keys, "m"), keys, "left")
    d = running(t, O.EPOCH, ["turn_index"], block_of(F.col("turn_index"), TURN_BLOCK), {
        **{n: Run("sum", F.coalesce(F.col(f"d_{n}"), F.lit(0))) for n in ("unresolved", "repeated", "repeats")},
        "standing": Run("last", F.col("m"))})
    return d.select(
        "stream_id", "seq", big("unresolved"), big("repeated"), big(F.coalesce("new_obligations", F.lit(0))).alias("fresh"),
        rounded(W.ratio(F.col("repeats"), F.col("unresolved")), "mean_repeats"),
        rounded(F.when(F.col("unresolved") > 0, F.col("turn_index") - F.col("standing.median_index")), "median_age"))


@query("a02_obligation_surface", shaped=True)
def _(k):
    return _surface(k, k.plain_ledger, k.intro)


@query("a02_surface_with_releases", shaped=True)
def _(k):
    return _surface(k, k.a.ledger, k.a.introductions)


@query("a03_dereference", shaped=True)
def _(k):
    return P.reliability(k.marked, P.outcomes(k.marked)).select(
        *KEY, *[big(f"pointer_{o}") for o in ("success", "failure", "unknown")], rounded(F.col("dereference"), "reliability"))


@query("a04_cycle_totals", shaped=True)
def _(k):
    return E.cycles(k.seqd).select(*KEY, *[big(n) for n in ("records", "agent_turns", "writes", "interrupts", "failed",
                                                            "text_expansions")], "claim_text")


@query("a06_current_objects")
def _(k):
    e = k.table("events").select(
        F.lit("all").alias("stream_id"), F.col("user_id").cast("string").alias("object_id"),
        F.col("event_id").alias("seq"), F.lit(0).alias("emit_rank"), F.lit(0).alias("sub"), F.lit(0).alias("item"), "event_type", "value")
    return EV.current_objects(e, "object_id").select("object_id", "seq", "event_type", "value")


@query("a07_regimes_seen", shaped=True)
def _(k):
    d = SU.regimes_seen(M.regime_changes(_simple_regimes(k)))
    return d.select("stream_id", F.array_join("regimes_seen", ",").alias("regimes_seen"))


@query("a09_semantic_operations")
def _(k):
    d = SU.semantic_operations(_completions(k))
    return d.select("stream_id", "recorded", "completed", "timed_out", "canceled", "failed",
                    F.array_join("classifiers", ",").alias("classifiers"), "p50_latency_ms", "p95_latency_ms")


def _survey(k):
    d = C.survey(k.feats)
    n = F.substring("stream_id", 3, 9).cast("long")
    return d.select(
        "stream_id", *[big(x) for x in ("records", "operator_turns", "actions", "write_actions", "interrupts")],
        F.concat(F.lit("p"), (n % 4).cast("string")).alias("project"),
        C.skip_reason(F.when(n % 7 == 0, "parent"), F.col("records") * 100, n % 11, F.col("operator_turns"),
                      max_bytes=11500, quiet_for=2, min_turns=40).alias("skipped"))


@query("a10_corpus_survey", shaped=True)
def _(k):
    return _survey(k).drop("project")


@query("a11_survey_roll_up", shaped=True)
def _(k):
    d = C.roll_up(_survey(k), "skipped")
    return d.select("skipped", big("sessions"), big("operator_turns"), big("actions"), big("projects"))


@query("a12_confusion")
def _(k):
    return L.confusion(k.scored_pairs)


def _score(k):
    return L.score(k.scored_pairs)


@query("a13_score")
def _(k):
    s = _score(k)
    return s.select("family", *[big(n) for n in s.columns if n not in ("family", "precision", "recall", "f1")],
                    *[rounded(F.col(n), n) for n in ("precision", "recall", "f1")])


@query("a14_kappa")
def _(k):
    d = L.kappa(k.label_table)
    return d.select("family", "labeler_a", "labeler_b", "units",
                    *[rounded(F.col(n), n) for n in ("observed", "expected", "kappa")])


@query("a15_discriminator_scores")
def _(k):
    d = L.score(L.discriminator_pairs(
        k.label_table.where("labeler = 'a'"), k.prediction_table, ("even", "long")), "discriminator")
    return d.select("discriminator", "true_positives", "false_positives", "false_negatives", "true_negatives",
                    rounded(F.col("precision"), "precision"))


@query("a16_coverage")
def _(k):
    return L.coverage(k.label_table, k.prediction_table)


@query("a17_consequences")
def _(k):
    d = L.consequences(_score(k))
    return d.select("family", rounded(F.col("inventory_ratio"), "inventory_ratio"), "unmarked_misses")


@query("a18_degenerate_pass")
def _(k):
    d = k.label_table.withColumn("labeler", F.concat("labeler", (F.col("li") % 40).cast("string"))).where("label <> 'unlabelable'")
    return L.degenerate_passes(d).select("family", "labeler", "units")


@query("a20_content_hash")
def _(k):
    d = k.table("conversations").select(F.col("conv_id").cast("string").alias("id"), "turn", "text")
    return C.content_hash(d, "id", "turn", "text")


@query("a20_file_digest")
def _(k):
    c = F.col
    d = k.table("conversations").select(
        c("conv_id").cast("string").alias("id"), F.concat("role", F.lit(".jsonl")).alias("name"), "turn",
        F.concat("text", F.lit("\n")).alias("line"))
    return C.file_digest(d, "id", "name", "turn", "line")


@query("a20_tree_digest")
def _(k):
    d = k.table("conversations").select(F.col("conv_id").cast("string").alias("id"), "turn", "text")
    return C.tree_digest(d, "id", "turn", "text")


# ---- top-k, sampling, sets ---------------------------------------------------------------------
@query("l01_top_inflation", shaped=True)
def _(k):
    d = k.turns.select("stream_id", "seq", F.when(F.col("seq") % 3 > 0, F.col("chars") / 100.0).alias("serialization_inflation"))
    return SU.top_inflation(d).select("stream_id", "seq", rounded(F.col("serialization_inflation"), "inflation"), big("rank"))


@query("l02_newest_sessions")
def _(k):
    d = k.table("events").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("root"),
                                 F.col("ts").alias("modified"))
    return C.newest(d).select("id", "root")


@query("l03_turn_sample", shaped=True)
def _(k):
    return k.feats.where("is_op").where(C.sampled(F.concat_ws("/", "stream_id", "turn_id"), 250)).select("stream_id", "turn_id")


@query("l04_split")
def _(k):
    return C.assign_split(_sessions(k).select("id", "project"))


@query("u04_path_union", shaped=True)
def _(k):
    d = k.feats.where("size(write_paths) > 0").select("stream_id", "seq", "write_paths")
    nxt = d.select("stream_id", (F.col("seq") - 2).alias("seq"), F.col("write_paths").alias("more"))
    return d.join(nxt, ["stream_id", "seq"]).select(
        "stream_id", "seq", F.array_join(F.array_union("write_paths", "more"), ",").alias("paths"))


# ---- folds and units ---------------------------------------------------------------------------
@query("k03_corrections", shaped=True)
def _(k):
    return k.fixed.where("is_correction").select("stream_id", "seq", "correction_marker", "target_type",
                                                 F.array_join("target_paths", ",").alias("paths"))


@query("k04_sentence_units")
def _(k):
    d = U.sentence_units(k.records.withColumn("is_op", FE.is_operator_turn(
        F.col("speaker_class"), F.col("sidechain"), F.col("input_mode"))))
    return d.select("session", "record", big("start"), big("end"), F.md5("text").alias("text_md5"), big("turn_lines"))


@query("k04_turn_context", shaped=True)
def _(k):
    d = U.cycle_context(k.records, k.seqd)
    return d.select("session", "turn_index", F.array_join("cycle_writes", ",").alias("cycle_writes"),
                    F.array_join("earlier_writes", ",").alias("earlier_writes"),
                    F.array_join("response_writes", ",").alias("response_writes"),
                    big("cycle_failed_calls"), big("response_failed_calls"), "cycle_interrupted", "response_interrupted")


@query("k05_attribution", shaped=True)
def _(k):
    return framed(k.turns.select("stream_id", "turn_index", "turn_id"), ["stream_id"], "turn_index", 1,
                  lambda w: {"settles": F.lag("turn_id").over(w)})


# ---- semantic results --------------------------------------------------------------------------
def _results(k):
    c = F.col
    n, size = c("conv_id") + c("turn"), F.octet_length("text")
    mid = F.floor(size / 2).cast("int")
    seg = lambda s, e, l: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), l.alias("label"))
    zero = F.lit(0)
    segs = (
        F.when(n % 9 == 0, F.array(seg(mid, size, F.lit("other")), seg(zero, mid, F.lit("meta_process"))))
        .when(n % 9 == 1, F.array(seg(zero, size + 1, F.lit("other"))))
        .when(n % 9 == 2, F.array(seg(zero, mid, F.lit("bogus"))))
        .otherwise(F.array(seg(zero, mid, F.lit("forward_work")), seg(mid + 2, mid + 3, F.lit("correction")))))
    ob = lambda kk, kind: F.struct(kk.alias("key"), kind.alias("kind"))
    res = lambda kk, e: F.struct(kk.alias("key"), F.lit("released").alias("kind"), e.alias("evidence"))
    key = F.when(n % 8 == 5, "zz").otherwise("aa")
    return k.table("conversations").select(
        "conv_id", "turn", "text", F.struct(
            F.when(n % 11 == 0, F.lit(1.5)).otherwise(F.lit(0.5)).alias("confidence"), segs.alias("segments"),
            F.struct((n % 5 == 0).alias("is_pointer"), F.when(n % 10 == 0, "file").otherwise("unknown").alias("type"),
                     F.lit("").alias("text")).alias("pointer"),
            F.struct(F.lit(False).alias("is_correction"), F.when(n % 13 == 0, "file").otherwise("").alias("target_type"),
                     F.lit("").alias("target_key")).alias("correction"),
            F.array(ob(F.lit("aa"), F.when(n % 7 == 3, "want").otherwise("stop")), ob(F.when(n % 6 == 1, "aa").otherwise("bb"), F.lit("scope"))).alias("obligations"),
            F.array(res(key, F.when(n % 14 == 9, " ").otherwise("said so"))).alias("resolutions")).alias("result"),
        F.array(F.lit("aa"), F.lit("bb")).alias("outstanding"))


@query("v01_result_problems")
def _(k):
    d = S.validate(_results(k))
    return d.select("conv_id", "turn", F.coalesce("problem", F.lit("ok")).alias("problem"))


@query("v02_tiles")
def _(k):
    d = S.validate(_results(k)).where("problem is null")
    t = d.select("conv_id", "turn", F.posexplode(S.tile(F.col("text"), F.col("result.segments"))).alias("i", "t"))
    return t.select("conv_id", "turn", big("t.start").alias("start"), big("t.end").alias("end"), "t.label")


@query("v03_allowed_resolutions")
def _(k):
    c = F.col
    res = k.table("events").select("event_id", F.concat(F.lit("c"), (c("user_id") % 3).cast("string")).alias("classifier"),
                                   F.element_at(F.array(F.lit("released"), F.lit("superseded"), F.lit("satisfied"), F.lit("odd")),
                                                (c("event_id") % 4 + 1).cast("int")).alias("kind"),
                                   F.when(c("event_id") % 5 == 0, "  ").otherwise(c("props")).alias("evidence"))
    caps = k.table("events").select(F.concat(F.lit("c"), (c("user_id") % 3).cast("string")).alias("classifier"),
                                    F.when(c("user_id") % 2 == 0, "obligation_release").otherwise("obligation_supersession")
                                    .alias("capability")).where("classifier <> 'c2'").distinct()
    return S.allowed_resolutions(res, caps).select("event_id", "classifier", "kind")


@query("v04_eligible", shaped=True)
def _(k):
    d = k.feats.withColumn("repair_open", F.col("seq") % 3 == 0)
    return S.eligible(d).select("stream_id", "seq", big("bytes"))


@query("v04_prior_turns", shaped=True)
def _(k):
    texts = k.turns.select("stream_id", "turn_index", "seq").join(k.records.select("stream_id", "seq", "text"), ["stream_id", "seq"])
    d = S.prior_turns(texts)
    return d.select("stream_id", "turn_index", big(F.size("prior")).alias("n"), F.md5(F.array_join("prior", "|")).alias("prior_md5"))


# ---- whole analysis (checked against brute force in the tests) ------------------------------------
@query("snapshots", shaped=True)
def _(k):
    return k.a.snapshots


@query("k01_repair_transitions", shaped=True)
def _(k):
    return k.a.episodes.where("out = 'event'").select(
        "stream_id", "seq", "phase", "ord", "kind", "repair_id", "status", "depth", "chars", "records", "reason")


@query("k01_pollution_assessments", shaped=True)
def _(k):
    return k.a.episodes.where("pollution_status is not null").select(
        "stream_id", "seq", "repair_id", "pollution_status", "cycle_records", "cycle_writes", "cycle_expansions")


@query("k02_releases", shaped=True)
def _(k):
    return k.a.claims.select("stream_id", "seq", big("pos"), "key", "marker", rounded(F.col("cover"), "cover"))


@query("k02_ledger_events", shaped=True)
def _(k):
    return k.a.occurrences.select("stream_id", "seq", big("pos"), "event", big("repeat_count"), "kind")


@query("k06_settlement", shaped=True)
def _(k):
    return SU.state_at_stop(k.a)


@query("a05_session_summary", shaped=True)
def _(k):
    d = SU.session_summary(k.a)
    return d.select(*[c for c in d.columns if c not in ("final", "pollution_by_repair", "regimes_seen")],
                    F.array_join("regimes_seen", ",").alias("regimes_seen"),
                    F.to_json("pollution_by_repair").alias("pollution_by_repair"))


@query("a08_corpus_rows", shaped=True)
def _(k):
    d = SU.corpus_rows(k.a)
    keep = ("first_drift", "first_recovery", "first_thrash")
    return d.select(*[F.to_json(c).alias(c) if c in keep else F.array_join(c, ",").alias(c) if c == "regimes_seen" else c
                      for c in d.columns])


@query("a19_repair_maxima", shaped=True)
def _(k):
    ev = k.a.episodes.where("out = 'event'")
    return ev.groupBy("stream_id").agg(
        F.max("depth").alias("max_depth"), F.max("chars").alias("max_chars"),
        F.count_if(F.col("kind") == "repair_opened").alias("opened"),
        F.count_if(F.col("kind") == "repair_durably_closed").alias("durable"))


@query("u01_anchors", shaped=True)
def _(k):
    return SU.anchors(k.a).select("stream_id", "seq", "kind", "detail")


@query("u02_event_log", shaped=True)
def _(k):
    records = k.a.records
    failed = records.where("is_op and chars % 7 = 0").select(
        "stream_id", "seq", F.lit("model").alias("classifier"), F.lit("1").alias("version"), F.lit("no answer").alias("error"))
    done = records.where("is_op").select(
        "stream_id", F.col("seq").alias("source_seq"), F.concat(F.lit("j"), F.col("seq").cast("string")).alias("job_id"),
        F.when(F.col("chars") % 7 == 0, "timed_out").otherwise("completed").alias("status"), F.lit("model").alias("classifier"),
        F.lit("1").alias("classifier_version"), F.md5("stream_id").alias("input_hash"))
    stops = records.select("stream_id").distinct().withColumn("reason", F.lit("end of table"))
    d = EV.with_ids(EV.event_log(k.a, done, failed, stops))
    return d.select("id", "stream_id", "seq", "epoch", "emit_rank", "sub", "item", "kind", "class")


@query("u03_predictions", shaped=True)
def _(k):
    return L.predictions(k.a, LEX).select("session", "record", "family", "start", "end", "value")
