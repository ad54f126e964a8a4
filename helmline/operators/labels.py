"""Human labels against rule predictions: validation, alignment, confusion, scores, agreement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helmline.operators.spans import matches
from helmline.plans.stage import stage

# The label vocabulary of each family and its positive classes.
UNLABELABLE = "unlabelable"
VOCABULARY = {
    "obligation": ("directive", "description", "task"),
    "obligation_pair": ("repeat", "supersedes", "releases", "unrelated"),
    "recovery": ("opens", "deepens", "unrelated"),
    "pollution": ("clean", "polluted", "failed", "unknown"),
}
POSITIVES = {
    "obligation": ("directive",),
    "obligation_pair": ("repeat",),
    "recovery": ("opens", "deepens"),
    "pollution": ("clean", "polluted", "failed"),
}

UNIT = ["session", "record", "family"]


def checked(labels: DataFrame) -> DataFrame:
    """Labels with the first rule they break in `problem`; NULL when valid."""
    c = F.col
    blank = lambda n: F.coalesce(c(n), F.lit("")) == ""
    allowed = F.lit(False)
    for family, names in VOCABULARY.items():
        allowed = allowed | ((c("family") == family) & c("label").isin(*names, UNLABELABLE))
    return labels.withColumn("problem", (
        F.when(blank("record"), "no_record")
        .when(~F.coalesce(c("family").isin(*VOCABULARY), F.lit(False)), "unknown_family")
        .when(blank("label"), "no_label")
        .when(~F.coalesce(allowed, F.lit(False)), "unknown_label")
        .when((c("label") == UNLABELABLE) & (F.trim(F.coalesce("note", F.lit(""))) == ""), "no_reason")
        .when(blank("labeler"), "no_labeler")))


def is_positive(family, value):
    out = F.lit(False)
    for name, values in POSITIVES.items():
        out = out | ((family == name) & value.isin(*values))
    return F.coalesce(out, F.lit(False))


def align(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Match labels and predictions by maximal byte overlap; both unmatched remainders are kept.

    `labels`: session, record, family, start, end, label, labeler, li (position, breaks ties).
    `predictions`: session, record, family, start, end, value, pi. A label with an empty session
    counts in every session. Whole-record units overlap by one byte. See `operators.spans`.
    """
    any_session = labels.where("session = ''").drop("session")
    spread = any_session.join(
        predictions.select("session", "record", "family").distinct(), ["record", "family"])
    nowhere = any_session.join(
        predictions.select("record", "family").distinct(), ["record", "family"], "left_anti"
    ).withColumn("session", F.lit(""))
    ls = labels.where("session <> ''").unionByName(spread.select(*labels.columns)).unionByName(
        nowhere.select(*labels.columns))
    matched = stage(matches(
        ls.select(*UNIT, "li", F.col("start").cast("long").alias("ls"), F.col("end").cast("long").alias("le")),
        predictions.select(*UNIT, "pi", F.col("start").cast("long").alias("ps"), F.col("end").cast("long").alias("pe")),
        UNIT), "matched")
    left = ls.join(matched, [*UNIT, "li"], "left")
    full = left.join(
        predictions.select(*UNIT, "pi", "value", F.col("start").alias("pred_start"),
                           F.col("end").alias("pred_end")), [*UNIT, "pi"], "left")
    cols = [*UNIT, "label", "labeler", F.col("start").cast("long").alias("label_start"),
            F.col("end").cast("long").alias("label_end"), "value", "pred_start", "pred_end", "overlap"]
    silent = predictions.join(matched.select(*UNIT, "pi"), [*UNIT, "pi"], "left_anti").select(
        *UNIT, F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("labeler"),
        F.lit(None).cast("long").alias("label_start"), F.lit(None).cast("long").alias("label_end"),
        "value", F.col("start").alias("pred_start"), F.col("end").alias("pred_end"),
        F.lit(None).cast("long").alias("overlap"))
    return full.select(*cols).unionByName(silent)


def confusion(pairs: DataFrame) -> DataFrame:
    """Every (labeled, predicted) cell, with '(silent)' and '(unlabeled)' for a missing side.

    Units nobody could label are no cell; `score` counts them apart.
    """
    return pairs.where(F.coalesce(F.col("label"), F.lit("")) != UNLABELABLE).groupBy(
        "family", F.coalesce("label", F.lit("(unlabeled)")).alias("labeled"),
        F.coalesce("value", F.lit("(silent)")).alias("predicted"),
    ).agg(F.count("*").alias("units"))


def score(pairs: DataFrame, *by: str) -> DataFrame:
    """Precision, recall and F1 per family; an undefined rate is NULL."""
    fam, c = F.col("family"), F.col
    judged = c("label").isNotNull() & (c("label") != UNLABELABLE)
    lp = judged & is_positive(fam, c("label"))
    pp = is_positive(fam, c("value"))
    d = pairs.groupBy("family", *by).agg(
        F.count_if(lp & pp).alias("true_positives"),
        F.count_if(judged & ~lp & pp).alias("false_positives"),
        F.count_if(lp & ~pp).alias("false_negatives"),
        F.count_if(judged & ~lp & ~pp).alias("true_negatives"),
        F.count_if(judged).alias("labeled_units"),
        F.count_if(c("label") == UNLABELABLE).alias("unlabelable_units"),
        F.count_if(lp & c("value").isNull()).alias("missed_by_build"))
    tp, fp, fn = c("true_positives"), c("false_positives"), c("false_negatives")
    d = d.withColumns({
        "predicted_positive": tp + fp, "labeled_positive": tp + fn,
        "precision": F.when(tp + fp > 0, tp / (tp + fp)),
        "recall": F.when(tp + fn > 0, tp / (tp + fn))})
    p, r = c("precision"), c("recall")
    return d.withColumn("f1", F.when((p > 0) & (r > 0), 2 * p * r / (p + r)))


def consequences(scores: DataFrame) -> DataFrame:
    """The score in the units a reader sees: inventory ratio, episodes seen, verdicts reached."""
    c = F.col
    return scores.select(
        "family",
        F.when((c("family") == "obligation") & (c("labeled_positive") > 0),
               c("predicted_positive") / c("labeled_positive")).alias("inventory_ratio"),
        F.when(c("family") == "obligation", c("missed_by_build")).alias("unmarked_misses"),
        F.when(c("family") == "recovery", c("true_positives")).alias("episodes_seen"),
        F.when(c("family") == "recovery", c("labeled_positive")).alias("episodes_labeled"),
        F.when(c("family") == "pollution", c("true_positives") + c("false_positives"))
        .alias("verdicts_reached"),
        F.when(c("family") == "pollution", c("false_positives")).alias("verdicts_wrong"))


# The tests every obligation prediction carries a verdict of.
DISCRIMINATORS = ("subject_before_marker", "not_second_person", "contained", "combined_shipped_rule")


def discriminator_pairs(labels: DataFrame, predictions: DataFrame, names=DISCRIMINATORS) -> DataFrame:
    """Alignment once per discriminator verdict in the `detail` map."""
    tag = lambda df: df.where("family = 'obligation'").select(
        "*", F.explode(F.array(*[F.lit(n) for n in names])).alias("discriminator")
    ).withColumn("family", F.concat_ws("|", "family", "discriminator"))
    ps = tag(predictions).withColumn("value", F.element_at("detail", F.col("discriminator")))
    out = align(tag(labels).drop("discriminator"), ps.where("value is not null").drop("discriminator"))
    return out.withColumns({
        "discriminator": F.element_at(F.split("family", r"\|"), 2),
        "family": F.element_at(F.split("family", r"\|"), 1)})


def coverage(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predicted, labeled and unlabelable units per family."""
    l = labels.groupBy("family").agg(
        F.count("*").alias("labeled"), F.count_if(F.col("label") == UNLABELABLE).alias("unlabelable"))
    p = predictions.groupBy("family").agg(F.count("*").alias("predicted"))
    zero = [F.coalesce(n, F.lit(0)).alias(n) for n in ("predicted", "labeled", "unlabelable")]
    return p.join(l, "family", "full_outer").select("family", *zero)


def kappa(labels: DataFrame) -> DataFrame:
    """Cohen's kappa per family and pair of labelers, over the units both judged."""
    unit = ["family", "session", "record", "start", "end"]
    last = labels.groupBy(*unit, "labeler").agg(F.max_by("label", "li").alias("label"))
    a = last.select(*unit, F.col("labeler").alias("labeler_a"), F.col("label").alias("label_a"))
    b = last.select(*unit, F.col("labeler").alias("labeler_b"), F.col("label").alias("label_b"))
    keys = ["family", "labeler_a", "labeler_b"]
    cells = a.join(b, unit).where("labeler_a < labeler_b").groupBy(*keys, "label_a", "label_b").agg(
        F.count("*").alias("n"))
    total = cells.groupBy(*keys).agg(
        F.sum("n").alias("units"),
        F.sum(F.when(F.col("label_a") == F.col("label_b"), F.col("n")).otherwise(0)).alias("same"))
    ra = cells.groupBy(*keys, F.col("label_a").alias("label")).agg(F.sum("n").alias("na"))
    rb = cells.groupBy(*keys, F.col("label_b").alias("label")).agg(F.sum("n").alias("nb"))
    chance = ra.join(rb, [*keys, "label"]).groupBy(*keys).agg(
        F.sum(F.col("na") * F.col("nb")).alias("products"))
    d = total.join(chance, keys, "left")
    obs = F.col("same") / F.col("units")
    exp = F.coalesce("products", F.lit(0)) / (F.col("units") * F.col("units"))
    return d.select(
        *keys, "units", obs.alias("observed"), exp.alias("expected"),
        F.when(exp < 1, (obs - exp) / (1 - exp)).alias("kappa"))


def degenerate_passes(labels: DataFrame) -> DataFrame:
    """Labeling passes that put two or more units all into one class."""
    return labels.groupBy("family", "labeler").agg(
        F.count("*").alias("units"), F.count_distinct("label").alias("classes")).where(
        "units > 1 and classes = 1")


def predictions(a, lex) -> DataFrame:
    """What the rules claimed, in label coordinates.

    Obligation candidates, kept and rejected, per sentence. Transitions go to the operator turn in
    play; a settlement made while an operator turn was read belongs to the turn before it.
    """
    from helmline.operators.features import describes

    c = F.col
    cand = a.sentences.select("stream_id", "turn_id", F.explode("cands").alias("k")).select(
        "stream_id", "turn_id", "k.*")
    said = lambda x: F.when(x, "description").otherwise("directive")
    detail = F.create_map(
        F.lit("subject_before_marker"), said(c("subject")),
        F.lit("not_second_person"), said(~c("second_person")),
        F.lit("contained"), said(c("contained")),
        F.lit("combined_shipped_rule"),
        said(describes(c("subject"), c("second_person"), c("contained"))))
    obligations = cand.select(
        c("stream_id").alias("session"), c("turn_id").alias("record"),
        F.lit("obligation").alias("family"), "start", "end", said(c("describes")).alias("value"),
        detail.alias("detail"))

    ids = a.turns.select("stream_id", "turn_index", c("turn_id").alias("record"))

    def whole(df, family, value):
        return df.join(ids, ["stream_id", "turn_index"]).select(
            c("stream_id").alias("session"), "record", F.lit(family).alias("family"),
            F.lit(0).alias("start"), F.lit(0).alias("end"), value.alias("value"),
            F.lit(None).cast("map<string,string>").alias("detail"))

    ev = a.episodes.where("out = 'event'")
    back = ev.where("pollution_status is not null").withColumn(
        "turn_index", c("turn_index") - (c("phase") < 7).cast("long"))
    return reduce(DataFrame.unionByName, [
        obligations,
        whole(ev.where("kind = 'repair_opened'"), "recovery", F.lit("opens")),
        whole(ev.where("kind in ('repair_deepened', 'repair_recurred')"), "recovery", F.lit("deepens")),
        whole(a.occurrences.where("event = 'repeated'"), "obligation_pair", F.lit("repeat")),
        whole(a.claims, "obligation_pair", F.lit("releases")),
        whole(back, "pollution", c("pollution_status")),
    ])
