"""Obligation ledger: introductions, repeats, releases, revivals, violations and the surface per turn.

Identity of a requirement is a pure key within (stream, epoch): its content key, or its normalized
sentence when no content word is left. Occurrences therefore need no search. Only the claims of
release sentences that can mean several requirements depend on order; they are a small fold over the
pairs that pass the match test, by connected requirements.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helmline.functions import text as T
from helmline.functions.components import connected
from helmline.functions.ordered import TURN_BLOCK, Run, block_of, current, running
from helmline.lexicon import DEFAULT as LEXICON
from helmline.plans.stage import stage

EPOCH = ["stream_id", "epoch_before"]


def occurrences(turns: DataFrame) -> DataFrame:
    """Kept candidates, one row per (turn, key), with identity and order inside the turn."""
    c = turns.select(
        *EPOCH, "turn_index", "seq", "turn_id", F.explode("kept").alias("c")
    ).select(*EPOCH, "turn_index", "seq", "turn_id", "c.*")
    first = c.groupBy(*EPOCH, "turn_index", "seq", "turn_id", "key").agg(
        F.min_by(F.struct("pos", "kind", "text", "content_key", "start", "end"), "pos").alias("c")
    ).select(*EPOCH, "turn_index", "seq", "turn_id", "key", "c.*")
    return first.withColumn("identity", identity())


def identity():
    return F.coalesce(F.nullif(F.col("content_key"), F.lit("")), F.col("key"))


def introductions(occ: DataFrame) -> DataFrame:
    """First occurrence of every identity: its own key, kind, text and place."""
    at = F.struct("turn_index", "pos")
    return occ.groupBy(*EPOCH, "identity").agg(
        F.min_by(F.struct("turn_index", "seq", "pos", "key", "kind", "text", "content_key"), at)
        .alias("o")
    ).select(*EPOCH, "identity", "o.*")


def _ranked_tokens(df: DataFrame, key, toks: str) -> DataFrame:
    """Explode a token set with each token's rank from rare to frequent inside its epoch."""
    one = df.select(*EPOCH, *key, F.explode(toks).alias("token"))
    freq = one.groupBy(*EPOCH, "token").agg(F.count("*").alias("df"))
    joined = one.join(freq, [*EPOCH, "token"])
    per = joined.groupBy(*EPOCH, *key).agg(
        F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ranked")
    )
    return per.select(
        *EPOCH, *key, F.transform("ranked", lambda r: r["token"]).alias("ranked")
    )


def release_pairs(turns: DataFrame, intro: DataFrame, lex=LEXICON) -> DataFrame:
    """Release sentences with the earlier requirements they restate well enough.

    A requirement of n tokens needs m = max(shared, ceil(coverage * n)) of them in the sentence, so
    one of its n - m + 1 rarest tokens must be there: only those are joined.
    """
    shared_min = int(lex.param("release_shared_tokens", 2))
    coverage = float(lex.param("release_coverage", 0.5))
    rel = turns.select(
        *EPOCH, "turn_index", "seq", "turn_id", F.explode("release_sents").alias("r")
    ).select(
        *EPOCH, "turn_index", "seq", "turn_id", F.col("r.pos").alias("pos"),
        T.lower(F.col("r.marker")).alias("marker"),
        T.token_set(T.without_first(F.col("r.text"), F.col("r.marker")))
        .alias("have"),
    )
    # Epochs without a release sentence take no part.
    live = intro.join(rel.select(*EPOCH).distinct(), EPOCH, "left_semi").select(
        *EPOCH, "identity", F.col("turn_index").alias("introduced"), "key",
        T.token_set(F.col("key")).alias("want"),
    )
    ranked = _ranked_tokens(live, ["identity"], "want")
    n = F.size("ranked")
    need = F.greatest(F.lit(shared_min), F.ceil(n * F.lit(coverage)).cast("int"))
    index = ranked.where(n >= need).select(
        *EPOCH, "identity", F.explode(F.slice("ranked", F.lit(1), n - need + 1)).alias("token")
    )
    probe = rel.select(*EPOCH, "turn_index", "pos", F.explode("have").alias("token"))
    met = probe.join(index, [*EPOCH, "token"]).select(
        *EPOCH, "turn_index", "pos", "identity"
    ).distinct()
    full = (
        met.join(rel, [*EPOCH, "turn_index", "pos"])
        .join(live, [*EPOCH, "identity"])
        .where(F.col("introduced") < F.col("turn_index"))
    )
    return full.select(
        *EPOCH, "turn_index", "seq", "turn_id", "pos", "marker", "identity", "key", "introduced",
        T.shared_tokens(F.col("have"), F.col("want")).alias("shared"),
        T.token_coverage(F.col("have"), F.col("want")).alias("cover"),
    ).where((F.col("shared") >= shared_min) & (F.col("cover") >= coverage))


CLAIMS = (
    "stream_id string, epoch_before long, turn_index long, seq long, turn_id string, pos int, "
    "identity string, key string, marker string, cover double"
)


def _claim_releases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs of connected requirements in order. State: for each released identity, the turn that released it."""
    released: dict[str, int] = {}
    group: list = []

    def settle(group, claimed):
        free = [
            r for r in group
            if r.identity not in claimed
            and not (r.identity in released and released[r.identity] > r.last_stated)
        ]
        if not free:
            return None
        top = max(r.cover for r in free)
        best = [r for r in free if r.cover == top]
        return best[0] if len(best) == 1 else None

    claimed: set[str] = set()
    turn = pos = None
    out = []

    def close():
        win = settle(group, claimed)
        if win is not None:
            claimed.add(win.identity)
            out.append((win.stream_id, win.epoch_before, win.turn_index, win.seq, win.turn_id,
                        win.pos, win.identity, win.key, win.marker, win.cover))

    def flush_turn():
        for row in out[flushed[0]:]:
            released[row[6]] = row[2]
        flushed[0] = len(out)

    flushed = [0]
    names = [c.split()[0] for c in CLAIMS.split(", ")]
    for batch in batches:
        for r in batch.itertuples(index=False):
            if (r.turn_index, r.pos) != (turn, pos):
                if group:
                    close()
                group = []
                if r.turn_index != turn:
                    flush_turn()
                    claimed = set()
                turn, pos = r.turn_index, r.pos
            group.append(r)
        if flushed[0]:
            yield pd.DataFrame(out[: flushed[0]], columns=names)
            del out[: flushed[0]]
            flushed[0] = 0
    if group:
        close()
    yield pd.DataFrame(out, columns=names)


def releases(pairs: DataFrame, occ: DataFrame) -> DataFrame:
    """Claims: per sentence the unique best still-standing requirement, each taken once per turn.

    A pair carries the last turn before it that stated the requirement; a release is undone by a
    statement at or after it, so no statement itself enters the fold. A requirement that never shares
    a sentence with another one is taken by the first sentence after each statement. Only where a
    sentence has to choose does order matter, and only among the requirements that such sentences
    connect: these are folded, one group of connected requirements at a time.
    """
    stated = occ.select(*EPOCH, "identity", F.col("turn_index").alias("stated")).distinct()
    asked = pairs.select(*EPOCH, "identity", F.col("turn_index").alias("stated")).distinct()
    both = stated.withColumn("real", F.lit(True)).unionByName(asked.withColumn("real", F.lit(False)))
    last = running(
        both.join(asked.select(*EPOCH, "identity").distinct(), [*EPOCH, "identity"], "left_semi"),
        [*EPOCH, "identity"], ["stated", "real"], block_of(F.col("stated"), TURN_BLOCK),
        {"last_stated": Run("last", F.when(F.col("real"), F.col("stated")), strict=True)},
    ).where(~F.col("real")).select(
        *EPOCH, "identity", F.col("stated").alias("turn_index"), "last_stated"
    )
    rows = stage(pairs.join(last, [*EPOCH, "identity", "turn_index"]).withColumn(
        "node", F.xxhash64(*EPOCH, "identity")), "standing-pairs")
    sentence = [*EPOCH, "turn_index", "pos"]
    torn = rows.groupBy(*sentence).agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = connected(rows.join(torn.drop("n"), sentence).select("node", "first"), "node", "first")
    names = [c.split()[0] for c in CLAIMS.split(", ")]
    alone = rows.join(groups, "node", "left_anti").groupBy(*EPOCH, "identity", "last_stated").agg(
        F.min_by(F.struct(*[c for c in names if c not in (*EPOCH, "identity")]), F.struct("turn_index", "pos"))
        .alias("r")
    ).select(*EPOCH, "identity", "r.*").select(*names)
    by = [*EPOCH, "group"]
    tied = rows.join(groups, "node").repartition(*by).sortWithinPartitions(*by, "turn_index", "pos", "identity")
    return alone.unionByName(tied.groupBy(*by).applyInPandas(_claim_releases, CLAIMS))


def ledger(occ: DataFrame, claimed: DataFrame) -> DataFrame:
    """One row per (identity, turn) that states or releases it, with the state before and after."""
    stated = occ.groupBy(*EPOCH, "identity", "turn_index").agg(F.count("*").alias("n"))
    rel = claimed.select(*EPOCH, "identity", "turn_index", F.lit(True).alias("released"))
    both = stated.join(rel, [*EPOCH, "identity", "turn_index"], "full_outer").select(
        *EPOCH, "identity", "turn_index", F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("released", F.lit(False)).alias("released"),
    )
    ends = F.when(F.col("released") & (F.col("n") == 0), "released").otherwise("unresolved")
    d = running(
        both.withColumn("end_state", ends), [*EPOCH, "identity"], ["turn_index"],
        block_of(F.col("turn_index"), TURN_BLOCK),
        {
            "prev_state": Run("last", F.col("end_state"), strict=True),
            "stated_before": Run("sum", F.col("n"), strict=True),
        },
    )
    at_apply = F.when(F.col("released"), "released").otherwise(F.col("prev_state"))
    return d.select(
        "*",
        (F.col("prev_state").isNull() & (F.col("n") > 0)).alias("introduced"),
        (F.coalesce(at_apply == "released", F.lit(False)) & (F.col("n") > 0)).alias("revived"),
    ).withColumn(
        "repeated",
        F.col("n") - F.col("introduced").cast("int") - F.col("revived").cast("int"),
    )


def statements(occ: DataFrame, led: DataFrame) -> DataFrame:
    """Every occurrence with its event: introduced, revived or repeated, and the repeat count then."""
    flags = led.select(*EPOCH, "identity", "turn_index", "introduced", "revived", "stated_before",
                       "prev_state")
    first = occ.groupBy(*EPOCH, "identity", "turn_index").agg(
        F.array_sort(F.collect_set("pos")).alias("order")
    )
    d = occ.join(first, [*EPOCH, "identity", "turn_index"]).join(
        flags, [*EPOCH, "identity", "turn_index"])
    nth = F.array_position("order", F.col("pos"))
    return d.select(
        *[c for c in occ.columns],
        F.when((nth == 1) & F.col("introduced"), "introduced")
        .when((nth == 1) & F.col("revived"), "revived").otherwise("repeated").alias("event"),
        (F.col("stated_before") + nth - 1).alias("repeat_count"),
        F.coalesce(F.col("prev_state") == "unresolved", F.lit(False)).alias("stood_before"),
    )


def near_repeats(occ: DataFrame, intro: DataFrame, led: DataFrame, lex=LEXICON) -> DataFrame:
    """Differently worded candidates that resemble a standing requirement.

    Jaccard ≥ t needs |x| between t·n and n/t and a common token among the n - ceil(t·n) + 1 rarest
    of both sides, so only those prefixes are joined, on distinct keys. Turns come back afterwards.
    """
    t = float(lex.param("near_repeat_threshold", 0.8))
    keys = occ.select(*EPOCH, "key", "identity").distinct().withColumn(
        "toks", T.token_set(F.col("key"))
    )
    ranked = _ranked_tokens(keys, ["key"], "toks").join(
        keys.select(*EPOCH, "key", "identity"), [*EPOCH, "key"])
    n = F.size("ranked")
    prefix = ranked.select(
        *EPOCH, "key", "identity", "ranked", n.alias("n"),
        F.explode(F.slice("ranked", F.lit(1), n - F.ceil(n * F.lit(t) - 1e-9).cast("int") + 1)).alias("token"),
    )
    prior = prefix.join(
        intro.select(*EPOCH, "identity", "key", F.col("turn_index").alias("introduced_turn")),
        [*EPOCH, "identity", "key"],
    ).select(
        *EPOCH, "token", F.col("key").alias("prior_key"), F.col("identity").alias("prior_identity"),
        F.col("ranked").alias("prior_ranked"), F.col("n").alias("prior_n"), "introduced_turn",
    )
    pairs = (
        prefix.join(prior, [*EPOCH, "token"])
        .where(
            (F.col("identity") != F.col("prior_identity"))
            & (F.col("n") + 1e-9 >= F.col("prior_n") * F.lit(t))
            & (F.col("prior_n") + 1e-9 >= F.col("n") * F.lit(t))
        )
        .select(*EPOCH, "key", "prior_key", "prior_identity", "introduced_turn",
                T.jaccard(F.col("ranked"), F.col("prior_ranked")).alias("jaccard"))
        .where(F.col("jaccard") >= t)
        .distinct()
    )
    hits = occ.select(*EPOCH, "turn_index", "seq", "pos", "key", "text").join(
        pairs, [*EPOCH, "key"]).where(F.col("introduced_turn") < F.col("turn_index"))
    off = standing_gaps(led).select(
        *EPOCH, F.col("identity").alias("prior_identity"), "from_turn", "to_turn")
    gone = (hits["turn_index"] > off["from_turn"]) & (hits["turn_index"] <= off["to_turn"])
    same = [hits[c] == off[c] for c in (*EPOCH, "prior_identity")]
    return hits.join(off, [*same, gone], "left_anti").select(
        *EPOCH, "turn_index", "seq", "key", "prior_key", "jaccard", "text"
    )


def standing_gaps(led: DataFrame) -> DataFrame:
    """Spans of turns over which an identity was released: (from_turn, to_turn] ends at its revival."""
    some = led.where("released").select(*EPOCH, "identity").distinct()
    d = running(
        led.join(some, [*EPOCH, "identity"], "left_semi"), [*EPOCH, "identity"], ["turn_index"],
        block_of(F.col("turn_index"), TURN_BLOCK),
        {"next_stated": Run("last", F.when(F.col("n") > 0, F.col("turn_index")), strict=True)},
        descending=True,
    )
    return d.where("end_state = 'released'").select(
        *EPOCH, "identity", F.col("turn_index").alias("from_turn"),
        F.coalesce("next_stated", F.lit((1 << 62))).alias("to_turn"),
    )


def violations(stated: DataFrame, corrections: DataFrame, intro: DataFrame) -> DataFrame:
    """(identity, turn) where a repeat happened inside a correction aimed at that requirement's key."""
    return (
        stated.where("event = 'repeated'").select(*EPOCH, "identity", "turn_index", "seq").distinct()
        .join(corrections.where("is_correction and target_key <> ''").select(
            *EPOCH, "turn_index", "target_key"), [*EPOCH, "turn_index"])
        .join(intro.select(*EPOCH, "identity", F.col("key").alias("target_key")),
              [*EPOCH, "identity", "target_key"], "left_semi")
        .select(*EPOCH, "identity", "turn_index", "seq")
    )


def surface_deltas(led: DataFrame, violated: DataFrame) -> DataFrame:
    """Change of every inventory count, summed per (stream, epoch, turn)."""
    v = violated.select(*EPOCH, "identity", "turn_index").distinct().withColumn(
        "hit", F.lit(True))
    d = led.join(v, [*EPOCH, "identity", "turn_index"], "left")
    mark = F.when(F.col("hit"), True).when(F.col("released"), False)
    d = running(
        d.withColumn("mark", mark), [*EPOCH, "identity"], ["turn_index"],
        block_of(F.col("turn_index"), TURN_BLOCK),
        {"violated_before": Run("last", F.col("mark"), strict=True)},
    )
    was = F.coalesce(F.col("prev_state") == "unresolved", F.lit(False))
    now = F.col("end_state") == "unresolved"
    rc_was = F.col("stated_before") - 1
    rc_now = F.col("stated_before") + F.col("n") - 1
    bad_was = was & F.coalesce(F.col("violated_before"), F.lit(False))
    bad_now = now & F.coalesce(F.col("mark"), F.col("violated_before"), F.lit(False))

    def step(after, before):
        return F.sum(after.cast("long")) - F.sum(before.cast("long"))

    return d.groupBy(*EPOCH, "turn_index").agg(
        step(now, was).alias("d_unresolved"),
        step(now & (rc_now > 0), was & (rc_was > 0)).alias("d_repeated"),
        step(F.when(now, rc_now).otherwise(0), F.when(was, rc_was).otherwise(0)).alias("d_repeats"),
        step(bad_now, bad_was).alias("d_violated"),
        step(~now, F.coalesce(F.col("prev_state") == "released", F.lit(False))).alias("d_released"),
        F.sum(F.col("introduced").cast("long")).alias("new_obligations"),
        F.max(F.col("repeated") > 0).alias("any_repeated"),
    )


MEDIANS = "stream_id string, epoch_before long, turn_index long, median_index double"


def _medians_of_span(rows: pd.DataFrame) -> pd.DataFrame:
    """Median introduction turn after every turn of one span of changes.

    Rows without a turn are the requirements around the median that stand before the span. `below` counts
    the standing ones of lower rank blocks than `low`, `total` all; what lies above `high` is only counted.
    """
    rows = rows.sort_values("turn_index", na_position="first", kind="stable")
    first = rows.iloc[0]
    below, total = int(first["below"]), int(first["total"])
    low = -1 if pd.isna(first["low"]) else int(first["low"])
    high = None if pd.isna(first["high"]) else int(first["high"])
    introduced = dict(zip(rows["rank"], rows["introduced_turn"]))
    before = rows["turn_index"].isna()
    held = sorted(rows["rank"][before])
    out = []
    for turn, changed in rows[~before].groupby("turn_index", sort=True):
        for rank, block, change in zip(changed["rank"], changed["rank_block"], changed["change"]):
            total += change
            if block < low:
                below += change
            elif high is None or block <= high:
                if change > 0:
                    bisect.insort(held, rank)
                else:
                    del held[bisect.bisect_left(held, rank)]
        mid = [introduced[held[k - below]] for k in ((total - 1) // 2, total // 2)] if total else None
        out.append((first["stream_id"], first["epoch_before"], turn, sum(mid) / 2 if mid else None))
    return pd.DataFrame(out, columns=[c.split()[0] for c in MEDIANS.split(", ")])


def _changed_medians(changes: DataFrame, size: int) -> DataFrame:
    """Medians of epochs with releases. changes: (epoch, identity, turn_index, change, introduced_turn, rank).

    Turns are cut into spans of about `size` changes, ranks into blocks of `size`. Counts per span and rank
    block say where the median is when a span begins; it can't leave the ranks around it by more than the
    changes of the span, so a span gets those requirements and its own changes, however many stand.
    """
    span = [*EPOCH, "span"]
    per_turn = changes.groupBy(*EPOCH, "turn_index").agg(F.count("*").alias("n"))
    cut = running(per_turn, EPOCH, ["turn_index"], block_of(F.col("turn_index"), TURN_BLOCK),
                  {"before": Run("sum", F.col("n"), strict=True)})
    changes = stage(changes.withColumn("rank_block", F.floor((F.col("rank") - 1) / size).cast("long")).join(
        cut.select(*EPOCH, "turn_index", F.floor(F.col("before") / size).cast("long").alias("span")),
        [*EPOCH, "turn_index"]), "changes")
    spans = changes.groupBy(*span).agg(F.count("*").alias("n"))
    last = spans.groupBy(*EPOCH).agg(F.max("span").alias("last"))

    by_block = Window.partitionBy(*EPOCH, "rank_block").orderBy("span")
    counts = (
        changes.groupBy(*EPOCH, "rank_block", "span").agg(F.sum("change").alias("net"))
        .withColumn("standing", F.sum("net").over(by_block)).withColumn("next", F.lead("span").over(by_block))
        .where("standing > 0").join(last, EPOCH)
        .withColumn("to", F.coalesce("next", "last")).where(F.col("to") > F.col("span"))
        .select(*EPOCH, "rank_block", "standing", F.explode(F.sequence(F.col("span") + 1, "to")).alias("span"))
        .join(spans, span)
    )
    up = Window.partitionBy(*span).orderBy("rank_block").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("through", F.sum("standing").over(up)).withColumn(
        "total", F.sum("standing").over(Window.partitionBy(*span)))
    mid, reach = (F.col("total") + 1) / 2, F.col("n") + 1
    chosen = stage(placed.where(
        (F.col("through") >= mid - reach) & (F.col("through") - F.col("standing") <= mid + reach)), "around-median")
    frames = chosen.groupBy(*span).agg(
        F.min(F.col("through") - F.col("standing")).alias("below"), F.max("total").alias("total"),
        F.min("rank_block").alias("low"), F.max("rank_block").alias("high"), F.max("through").alias("top")
    ).select(*span, "below", "total", F.when(F.col("below") > 0, F.col("low")).alias("low"),
             F.when(F.col("top") < F.col("total"), F.col("high")).alias("high"))

    stays = running(changes, [*EPOCH, "identity"], ["turn_index"], block_of(F.col("turn_index"), TURN_BLOCK),
                    {"left": Run("last", F.col("span"), strict=True)}, descending=True
                    ).where((F.col("change") > 0) & (F.col("left").isNull() | (F.col("left") > F.col("span"))))
    held = chosen.select(*span, "rank_block").join(
        stays.select(*EPOCH, "rank_block", F.col("span").alias("came"), "left", "rank", "introduced_turn"),
        [*EPOCH, "rank_block"]
    ).where((F.col("came") < F.col("span")) & (F.col("left").isNull() | (F.col("left") >= F.col("span"))))
    rows = held.select(*span, F.lit(None).cast("long").alias("turn_index"), F.lit(1).alias("change"), "rank",
                       "rank_block", "introduced_turn").unionByName(
        changes.select(*span, "turn_index", "change", "rank", "rank_block", "introduced_turn"))
    rows = rows.join(frames, span, "left").fillna(0, ["below", "total"])
    return rows.groupBy(*span).applyInPandas(_medians_of_span, MEDIANS)


def standing_medians(led: DataFrame, intro: DataFrame) -> DataFrame:
    """Median introduction turn of the standing requirements, at each turn that changes the set.

    Without a release in the epoch the standing set is the first k introductions, and the median is a
    lookup by rank. Epochs with releases are folded in spans of changes.
    """
    touched = led.where("released").select(*EPOCH).distinct()
    order = running(
        intro.select(*EPOCH, "turn_index", "pos", "identity"), EPOCH, ["turn_index", "pos"],
        block_of(F.col("turn_index"), TURN_BLOCK), {"rank": Run("sum", F.lit(1).cast("long"))},
    )
    ranked = order.join(touched, EPOCH, "left_anti")
    counts = ranked.groupBy(*EPOCH, "turn_index").agg(F.max("rank").alias("k"))
    at = ranked.select(*EPOCH, F.col("turn_index").alias("idx"), "rank")
    lo = at.select(*EPOCH, F.col("idx").alias("lo"), F.col("rank").alias("lo_rank"))
    hi = at.select(*EPOCH, F.col("idx").alias("hi"), F.col("rank").alias("hi_rank"))
    native = (
        counts.withColumn("lo_rank", F.floor((F.col("k") + 1) / 2).cast("long"))
        .withColumn("hi_rank", F.floor(F.col("k") / 2).cast("long") + 1)
        .join(lo, [*EPOCH, "lo_rank"]).join(hi, [*EPOCH, "hi_rank"])
        .select(*EPOCH, "turn_index", ((F.col("lo") + F.col("hi")) / F.lit(2.0)).alias("median_index"))
    )
    was = F.coalesce(F.col("prev_state") == "unresolved", F.lit(False)).cast("int")
    now = (F.col("end_state") == "unresolved").cast("int")
    changes = (
        led.join(touched, EPOCH, "left_semi").where(was != now)
        .select(*EPOCH, "identity", "turn_index", (now - was).alias("change"))
        .join(order.select(*EPOCH, "identity", F.col("turn_index").alias("introduced_turn"), "rank"),
              [*EPOCH, "identity"])
    )
    return native.unionByName(_changed_medians(stage(changes, "changes"), current().turn_rows))
