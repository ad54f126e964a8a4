"""DuckDB SQL for the registered queries, written from the base tables."""

from __future__ import annotations

from helmline.functions.text import CLOSED_CLASS_WORDS, NEGATION_WORDS, PRE_SUBJECT_WORDS
from helmline.lexicon import BASELINE_MARKERS, CASE_SENSITIVE_GROUPS
from helmline.plans import formats
from helmline.plans.transcripts import SEED_SQL

SP = r"[\s\v\x{85}\p{Z}]"


def lit(s):
    return "'" + s.replace("'", "''") + "'"


def pat(g):
    return lit(("" if g in CASE_SENSITIVE_GROUPS else "(?i)") + BASELINE_MARKERS[g])


def m(g, x):
    return f"regexp_matches({x}, {pat(g)})"


def find(g, x):
    return f"regexp_extract({x}, {pat(g)})"


def trim(x):
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def norm(x):
    return (f"regexp_replace(regexp_replace(lower({x}), '{SP}+', ' ', 'g'), "
            r"'^[\p{P} ]+|[\p{P} ]+$', '', 'g')")


def toks(x):
    return (f"list_filter(list_transform(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{Nd}}_\\-/.]+'), "
            "lambda t: trim(t, '-./_')), lambda t: t <> '')")


def words(ws):
    return "[" + ", ".join(lit(w) for w in ws) + "]"


def jac(a, b):
    i = f"len(list_intersect({a}, {b}))"
    return (f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {i}::DOUBLE / "
            f"(len({a}) + len({b}) - {i}) END")


def first_of(pairs, default):
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


LABEL_RULES = (
    ("reset", "handoff"), ("correction_tier1", "correction"), ("stop", "stop_condition"),
    ("scope", "scope_constraint"), ("negative", "negative_constraint"),
    ("positive", "positive_constraint"), ("meta", "meta_process"), ("new_task_line", "new_task"),
    ("referent", "referent_disambiguation"), ("reconstruction", "restart_reconstruction"),
    ("temporal", "temporal_disambiguation"), ("evidence", "new_evidence"), ("forward", "forward_work"))
BUCKET = first_of([
    ("{x} IN ('forward_work','new_task','new_evidence')", "'FORWARD'"),
    ("{x} IN ('scope_constraint','negative_constraint','positive_constraint','stop_condition',"
     "'meta_process','handoff')", "'CONTROL'"),
    ("{x} IN ('correction','referent_disambiguation','temporal_disambiguation',"
     "'restart_reconstruction')", "'RECOVERY'"),
    ("{x} = 'restated_prior_state'", "'RESTATE'")], "'OTHER'")

SPLIT = (r"regexp_replace(regexp_replace(regexp_replace({t}, '([.!?][.!?\")]*[ \t]+)', '\1' || chr(1), 'g'), "
         r"'([.!?][.!?\")]*)\n', '\1' || chr(1) || chr(10), 'g'), '\n', chr(10) || chr(1), 'g')").replace(r'\"', '"')


def sentences(src, keys):
    """CTE body: keys, pos, start_b, end_b, chars, s, contained."""
    k = ", ".join(keys)
    return f"""
  SELECT {k}, pos, start_b, end_b, chars, s,
    (starts_with(head, '```') OR fences_before % 2 = 1 OR starts_with(head, '>')) AS contained
  FROM (
    SELECT *, first_value(s) OVER (PARTITION BY {k}, line ORDER BY pos) AS head,
      coalesce(sum((bol AND starts_with(s, '```'))::INT) OVER (PARTITION BY {k} ORDER BY line
        RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fences_before
    FROM (
      SELECT {k}, i, raw, {trim('raw')} AS s, row_number() OVER w - 1 AS pos,
        coalesce(sum(strlen(raw)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_b,
        sum(strlen(raw)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS end_b,
        length(raw) AS chars, coalesce(ends_with(lag(raw) OVER w, chr(10)), true) AS bol,
        coalesce(sum(ends_with(raw, chr(10))::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line
      FROM (SELECT {k}, unnest(l) AS raw, generate_subscripts(l, 1) AS i FROM (
              SELECT {k}, string_split({SPLIT.format(t='text')}, chr(1)) AS l FROM {src}))
      WHERE raw <> '' WINDOW w AS (PARTITION BY {k} ORDER BY i)))"""


SK = ["stream_id", "seq"]
CTES = {
    "recs": ([], f"""
  SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY ord) AS seq,
    make_timestamp(ts_s * 1000000) AS ts,
    (speaker_class = 'human' AND NOT sidechain AND input_mode = '') AS is_op,
    (speaker_class = 'agent') AS is_agent,
    (input_mode = 'interrupt') AS is_interrupt,
    CASE WHEN failed AND write_path IS NULL THEN 1 WHEN failed THEN 1 + (write_path2 IS NOT NULL)::INT ELSE 0 END AS n_failed,
    list_distinct(list_filter([write_path, write_path2], lambda x: x IS NOT NULL)) AS writes_any,
    list_filter([write_path, write_path2], lambda x: x IS NOT NULL) AS writes,
    (write_path IS NOT NULL)::INT + (write_path2 IS NOT NULL)::INT + (failed AND write_path IS NULL)::INT AS n_actions
  FROM ({SEED_SQL})"""),
    "ops": (["recs"], f"""
  SELECT *, length(text) AS chars, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS turn_index,
    {m('reset', 'text')} AS reset, length(text) - length(replace(text, chr(10), '')) + 1 > 40 AS bulk
  FROM recs WHERE is_op"""),
    "t0": (["ops"], """
  SELECT *, coalesce(sum(reset::INT) OVER (PARTITION BY stream_id ORDER BY turn_index
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS epoch_before,
    coalesce(lag(reset) OVER (PARTITION BY stream_id ORDER BY turn_index), false) AS opens_epoch
  FROM ops"""),
    "turns": (["t0"], f"""
  SELECT *, max(CASE WHEN opens_epoch THEN turn_index END) OVER (PARTITION BY stream_id ORDER BY turn_index
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS first_before,
    CASE WHEN NOT bulk THEN nullif(lower({find('correction_tier1', 'text')}), '') END AS tier1,
    CASE WHEN NOT bulk THEN nullif(lower({find('correction_tier2', 'text')}), '') END AS tier2
  FROM t0"""),
    "rsent": (["recs"], sentences("recs", SK)),
    "sent": (["turns", "rsent"], """
  SELECT r.*, t.turn_index, t.epoch_before, t.first_before, t.bulk FROM rsent r
  JOIN turns t USING (stream_id, seq) WHERE r.s <> ''"""),
    "lab": (["sent"], f"""
  SELECT *, {first_of([(m(g, 's'), lit(l)) for g, l in LABEL_RULES], "'other'")} AS label,
    {norm('s')} AS norm FROM sent"""),
    "cand": (["sent"], f"""
  SELECT *, {first_of([(m(g, 's'), lit(g)) for g in ('stop', 'scope', 'negative', 'positive')], 'NULL')} AS kind,
    {norm('s')} AS key, {toks('s')} AS tk,
    {m('second_person', 's')} AS second_person,
    least({', '.join(f"CASE WHEN {m(g, 's')} THEN strpos(s, {find(g, 's')}) END" for g in ('stop', 'scope', 'negative', 'positive'))}) AS mk_at
  FROM sent WHERE NOT {m('release', 's')}"""),
    "cands": (["cand"], f"""
  SELECT *, CASE WHEN len(content) = 0 THEN '' ELSE
      (CASE WHEN len(list_intersect(tk, {words(NEGATION_WORDS)})) > 0 THEN '!not ' ELSE '' END)
      || array_to_string(list_sort(content), ' ') END AS content_key,
    contained OR (subject AND NOT second_person) AS describes
  FROM (SELECT *,
      list_distinct(list_filter(tk, lambda t: strlen(t) >= 2 AND NOT list_contains(
        {words(CLOSED_CLASS_WORDS + NEGATION_WORDS)}, t))) AS content,
      len(list_filter({toks('substr(s, 1, mk_at - 1)')}, lambda t: NOT list_contains({words(PRE_SUBJECT_WORDS)}, t))) > 0 AS subject
    FROM cand WHERE kind IS NOT NULL AND strlen(key) >= 8)"""),
    "ptr": (["turns"], "SELECT stream_id, seq, turn_index, epoch_before, chars, ptype, ptext, length(ptext) AS pchars, "
            + norm("ptext") + " AS pkey FROM (SELECT *, "
            + first_of([(m("pointer_" + k, "text"), lit(k)) for k in ("task", "file", "namespace", "operation", "quote", "alias")], "NULL")
            + " AS ptype, "
            + first_of([(m("pointer_" + k, "text"), find("pointer_" + k, "text")) for k in ("task", "file", "namespace", "operation", "quote", "alias")], "NULL")
            + " AS ptext FROM turns) WHERE ptype IS NOT NULL"),
    "occ": (["cands"], """
  SELECT *, coalesce(nullif(content_key, ''), key) AS identity FROM (
    SELECT *, row_number() OVER (PARTITION BY stream_id, seq, key ORDER BY pos) AS dup FROM cands WHERE NOT describes)
  WHERE dup = 1"""),
    "stated": (["occ"], """
  SELECT *, row_number() OVER (PARTITION BY stream_id, epoch_before, identity ORDER BY turn_index, pos) - 1 AS repeat_count,
    min(turn_index) OVER (PARTITION BY stream_id, epoch_before, identity) < turn_index AS stood_before
  FROM occ"""),
    "restated": (["lab"], """
  SELECT a.stream_id, a.seq, a.turn_index, a.pos FROM lab a WHERE strlen(a.norm) >= 8 AND EXISTS (
    SELECT 1 FROM lab b WHERE b.stream_id = a.stream_id AND b.norm = a.norm AND b.turn_index < a.turn_index
      AND b.turn_index >= greatest(a.turn_index - 30, coalesce(a.first_before, 1)))"""),
    "flab": (["lab", "restated"], """
  SELECT l.*, CASE WHEN r.pos IS NOT NULL AND l.label NOT IN ('handoff', 'correction') THEN 'restated_prior_state'
    ELSE l.label END AS label2 FROM lab l LEFT JOIN restated r USING (stream_id, seq, turn_index, pos)"""),
    "buckets": (["flab", "turns"], f"""
  SELECT t.*, coalesce(forward, 0) AS forward, coalesce(control, 0) AS control, coalesce(recovery, 0) AS recovery,
    coalesce(restate, 0) AS restate, coalesce(other, 0) AS other, coalesce(handoff, 0) AS handoff
  FROM turns t LEFT JOIN (
    SELECT stream_id, seq, sum(chars) FILTER (b = 'FORWARD') AS forward,
      sum(chars) FILTER (b = 'CONTROL' AND label2 <> 'handoff') AS control,
      sum(chars) FILTER (b = 'RECOVERY') AS recovery, sum(chars) FILTER (b = 'RESTATE') AS restate,
      sum(chars) FILTER (b = 'OTHER') AS other, sum(chars) FILTER (label2 = 'handoff') AS handoff
    FROM (SELECT *, {BUCKET.replace('{x}', 'label2')} AS b FROM flab) GROUP BY 1, 2) x USING (stream_id, seq)"""),
    "shares": (["buckets"], """
  SELECT *, fw + co + re + rs + ot AS total FROM (
    SELECT *, sum(forward) OVER w AS fw, sum(control + handoff) OVER w AS co, sum(recovery) OVER w AS re,
      sum(restate) OVER w AS rs, sum(other) OVER w AS ot FROM buckets
    WINDOW w AS (PARTITION BY stream_id, epoch_before ORDER BY turn_index ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""),
    "corr": (["buckets", "stated", "ptr"], f"""
  SELECT b.*, p.ptype, p.pkey,
    coalesce(b.tier1, CASE WHEN s.seq IS NOT NULL THEN b.tier2 END) AS marker,
    coalesce(o.key, p.pkey, '') AS tkey0,
    regexp_matches(fs, {pat('acceptance')}) OR forward > 0 AS moves
  FROM (SELECT *, {trim("regexp_extract(" + SPLIT.format(t="text") + ", '^[^' || chr(1) || ']*')")} AS fs FROM buckets) b
  LEFT JOIN (SELECT DISTINCT stream_id, seq FROM stated WHERE stood_before) s USING (stream_id, seq)
  LEFT JOIN ptr p USING (stream_id, seq)
  LEFT JOIN (SELECT stream_id, seq, arg_min(key, pos) AS key FROM cands WHERE NOT describes AND kind IN ('stop', 'scope')
    GROUP BY 1, 2) o USING (stream_id, seq)"""),
    "seqd": (["recs", "turns"], """
  SELECT r.*, sum(r.is_op::INT) OVER w AS turn_index,
    coalesce(sum(coalesce(t.reset, false)::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch_before,
    sum(coalesce(t.reset, false)::INT) OVER w AS epoch
  FROM recs r LEFT JOIN turns t USING (stream_id, seq) WINDOW w AS (PARTITION BY r.stream_id ORDER BY r.seq)"""),
    "overlap": (["seqd"], """
  SELECT stream_id, turn_index, arg_min(seq, seq) AS overlap_seq, arg_min(o, seq) AS overlap FROM (
    SELECT stream_id, turn_index, seq, array_to_string(list(path ORDER BY i), ',') AS o FROM (
      SELECT stream_id, turn_index, seq, unnest(writes_any) AS path, generate_subscripts(writes_any, 1) AS i
      FROM (SELECT *, CASE WHEN write_path = write_path2 THEN [write_path] ELSE writes END AS w2 FROM seqd) x
      WHERE is_agent AND turn_index >= 1) w
    WHERE EXISTS (SELECT 1 FROM seqd b WHERE b.stream_id = w.stream_id AND b.is_agent AND b.turn_index = w.turn_index - 1
      AND b.turn_index >= 1 AND list_contains(b.writes_any, w.path))
    GROUP BY 1, 2, 3) GROUP BY 1, 2"""),
    "lbl": ([], """
  SELECT 's' || (doc_id % 7) AS session, 'd' || doc_id AS record, 'obligation' AS family, 0 AS start_b, doc_id % 5 * 3 AS end_b,
    CASE WHEN doc_id % 13 = 0 THEN 'unlabelable' WHEN v THEN 'directive' ELSE 'description' END AS label, labeler,
    CASE WHEN doc_id % 26 = 0 THEN '' ELSE 'why' END AS note, doc_id * 2 + (labeler = 'b')::INT AS li, doc_id
  FROM (SELECT doc_id, quality = 1 AS v, 'a' AS labeler FROM labels UNION ALL SELECT doc_id, toxic = 0, 'b' FROM labels)"""),
    "prd": ([], """
  SELECT 's' || (doc_id % 7) AS session, 'd' || doc_id AS record, 'obligation' AS family, doc_id % 2 + beyond AS start_b,
    doc_id % 5 * 3 + 2 * (doc_id % 4) - 2 + 2 * beyond AS end_b, CASE WHEN n_chars % 2 = 0 THEN 'directive' ELSE 'description' END AS value,
    CASE WHEN n_chars > 900 THEN 'directive' ELSE 'description' END AS value2, doc_id AS pi
  FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 1000 ELSE 0 END AS beyond FROM documents)"""),
    "met": (["lbl", "prd"], """
  SELECT l.session, l.record, l.label, p.value, p.value2, p.pi,
    CASE WHEN l.end_b <= l.start_b OR p.end_b <= p.start_b THEN 1 ELSE least(l.end_b, p.end_b) - greatest(l.start_b, p.start_b) END AS overlap
  FROM lbl l JOIN prd p USING (session, record)
  WHERE l.labeler = 'a' AND (l.end_b <= l.start_b OR p.end_b <= p.start_b OR least(l.end_b, p.end_b) > greatest(l.start_b, p.start_b))"""),
    "pairs": (["met"], """
  SELECT session, record, label, value, value2, overlap FROM met
  UNION ALL SELECT session, record, label, NULL, NULL, NULL FROM lbl WHERE labeler = 'a' AND record NOT IN (SELECT record FROM met)
  UNION ALL SELECT session, record, NULL, value, value2, NULL FROM prd WHERE pi NOT IN (SELECT pi FROM met)"""),
    "compl": ([], """
  SELECT 'j' || (conv_id * 10 + turn) AS job_id, 's-' || (conv_id % 50) AS stream_id, turn + 1 AS source_seq, md5(role) AS input_hash,
    CASE WHEN turn % 4 = 3 THEN '' ELSE 'model' END AS classifier, '1' AS classifier_version,
    CASE WHEN conv_id % 5 = 0 THEN 'old' ELSE 'h1' END AS classifier_hash,
    ['completed', 'completed', 'timed_out', 'canceled', 'broken'][conv_id % 5 + 1] AS status, length(text) - 30 AS latency_ms
  FROM conversations"""),
    "survey": (["recs"], """
  SELECT *, CAST(substr(stream_id, 3) AS BIGINT) AS n FROM (
    SELECT stream_id, count(*) AS records, count(*) FILTER (is_op) AS operator_turns, sum(n_actions)::BIGINT AS actions,
      sum(len(writes_any))::BIGINT AS write_actions, count(*) FILTER (is_interrupt) AS interrupts FROM recs GROUP BY 1)"""),
    "surveyed": (["survey"], """
  SELECT *, 'p' || (n % 4) AS project, CASE WHEN n % 7 = 0 THEN 'subagent' WHEN records * 100 > 11500 THEN 'too_large'
    WHEN n % 11 < 2 THEN 'recent' WHEN operator_turns < 40 THEN 'too_few_turns' ELSE '' END AS skipped FROM survey"""),
    "base": (["turns", "ptr"], """
  SELECT t.stream_id, t.epoch_before, t.turn_index, t.chars, t.tier1, p.ptype FROM turns t LEFT JOIN ptr p USING (stream_id, seq)"""),
    "entries": (["base"], """
  SELECT stream_id, epoch_before, turn_index AS app, 1 AS late, turn_index AS ord, chars FROM base WHERE tier1 IS NULL AND ptype IS NULL
  UNION ALL
  SELECT b.stream_id, b.epoch_before, b.turn_index + 2, 0, b.turn_index, b.chars FROM base b JOIN base c
    ON c.stream_id = b.stream_id AND c.epoch_before = b.epoch_before AND c.turn_index = b.turn_index + 2
  WHERE b.tier1 IS NULL AND b.ptype IS NOT NULL"""),
    "basel": (["base", "entries"], """
  SELECT b.*, (SELECT list(chars) FROM (SELECT chars FROM entries e WHERE e.stream_id = b.stream_id AND e.epoch_before = b.epoch_before
      AND (e.app < b.turn_index OR (e.app = b.turn_index AND e.late = 0)) ORDER BY e.app DESC, e.late DESC, e.ord DESC LIMIT 30)) AS xs
  FROM base b"""),
    "simple": (["turns"], """
  SELECT *, lag(regime, 1, 'FLOW') OVER (PARTITION BY stream_id ORDER BY turn_index) AS was FROM (
    SELECT *, CASE WHEN reset THEN 'RESET' WHEN tier1 IS NOT NULL THEN 'RECOVERY' WHEN chars % 5 = 0 THEN 'DRIFT' ELSE 'FLOW' END AS regime FROM turns)"""),
    "ptro": (["corr", "ptr", "seqd"], """
  SELECT p.*, e.first_eval, r.next_reset,
    CASE WHEN e.first_eval <= coalesce(r.next_reset, 1e15) THEN e.first_eval END AS e0
  FROM ptr p
  LEFT JOIN LATERAL (SELECT min(s.turn_index) + 1 AS first_eval FROM seqd s WHERE s.stream_id = p.stream_id AND s.is_agent AND s.seq > p.seq) e ON true
  LEFT JOIN LATERAL (SELECT min(c.turn_index) AS next_reset FROM corr c WHERE c.stream_id = p.stream_id AND c.reset AND c.turn_index >= p.turn_index) r ON true"""),
    "outc": (["ptro", "corr"], """
  SELECT p.stream_id, p.seq, p.turn_index, p.ptype, p.next_reset, c0.turn_index AS t0,
    c0.marker IS NOT NULL AS fix0, c0.moves AS mv0,
    CASE WHEN c1.marker IS NOT NULL AND c1.tkey0 <> '' AND c1.tkey0 = p.pkey THEN c1.turn_index
         WHEN c2.marker IS NOT NULL AND c2.tkey0 <> '' AND c2.tkey0 = p.pkey THEN c2.turn_index END AS named, c2.turn_index AS t2
  FROM ptro p LEFT JOIN corr c0 ON c0.stream_id = p.stream_id AND c0.turn_index = p.e0
  LEFT JOIN corr c1 ON c1.stream_id = p.stream_id AND c1.turn_index = p.e0 + 1 AND c1.turn_index <= coalesce(p.next_reset, 1e15)
  LEFT JOIN corr c2 ON c2.stream_id = p.stream_id AND c2.turn_index = p.e0 + 2 AND c2.turn_index <= coalesce(p.next_reset, 1e15)"""),
    "outcomes": (["outc"], """
  SELECT stream_id, seq, turn_index, ptype,
    CASE WHEN t0 IS NULL THEN 'unknown' WHEN fix0 THEN 'failure' WHEN mv0 THEN 'success' WHEN named IS NOT NULL THEN 'failure' ELSE 'unknown' END AS outcome,
    CASE WHEN t0 IS NOT NULL AND (fix0 OR mv0) THEN 'first_response' WHEN named IS NOT NULL THEN 'same_target'
      WHEN t2 IS NOT NULL THEN 'window' WHEN next_reset IS NOT NULL THEN 'epoch_end' ELSE 'source_end' END AS evidence,
    CASE WHEN t0 IS NOT NULL AND (fix0 OR mv0) THEN t0 WHEN named IS NOT NULL THEN named WHEN t2 IS NOT NULL THEN t2
      ELSE next_reset END AS settled_turn FROM outc"""),
    "calls": ([], """SELECT user_id::VARCHAR AS path, event_id AS pos, (event_id % 50)::VARCHAR AS call_id FROM events WHERE event_type IN ('click', 'view')"""),
    "results": ([], """SELECT user_id::VARCHAR AS path, event_id AS pos, (event_id % 50)::VARCHAR AS call_id, value > 10 AS is_error FROM events WHERE event_type = 'error'"""),
    "dealt": ([], """
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY h) AS nth,
    ('0x' || substr(sha256(project), 16, 1))::INT % 2 AS odd FROM (
    SELECT 'd' || doc_id AS id, source AS project, doc_id, substr(sha256('d' || doc_id), 1, 16) AS h FROM documents WHERE {where})"""),
    "banded": (["shares"], """
  SELECT stream_id, turn_index, metric, band FROM (
    SELECT stream_id, turn_index, unnest(['control_plane_burden', 'forward_work_share', 'serialization_inflation', 'repair_depth']) AS metric,
      unnest([CASE WHEN total = 0 THEN NULL WHEN (co + re + rs) / total <= 0.25 THEN 'good' WHEN (co + re + rs) / total <= 0.5 THEN 'mid' ELSE 'bad' END,
        CASE WHEN total = 0 THEN NULL WHEN fw / total >= 0.6 THEN 'good' WHEN fw / total >= 0.35 THEN 'mid' ELSE 'bad' END,
        CASE WHEN turn_index % 5 = 0 THEN NULL WHEN chars / 80.0 >= 6 THEN 'bad' WHEN chars / 80.0 >= 3 THEN 'mid' ELSE 'good' END,
        CASE WHEN turn_index // 3 % 4 >= 3 THEN 'bad' WHEN turn_index // 3 % 4 > 0 THEN 'mid' ELSE 'good' END]) AS band FROM shares)
  WHERE band IS NOT NULL"""),
    "islands": (["banded"], """
  SELECT *, row_number() OVER (PARTITION BY stream_id, metric, grp ORDER BY turn_index) AS held FROM (
    SELECT *, sum(chg) OVER (PARTITION BY stream_id, metric ORDER BY turn_index) AS grp FROM (
      SELECT *, CASE WHEN band = lag(band) OVER (PARTITION BY stream_id, metric ORDER BY turn_index) THEN 0 ELSE 1 END AS chg FROM banded))"""),
    "res": ([], """
  SELECT conv_id, turn, conv_id + turn AS n, strlen(text) AS sz, strlen(text) // 2 AS mid, text, encode(text) AS bytes FROM conversations"""),
    "cont": (["res"], """
  SELECT *, mid = sz OR (ord_at(bytes, mid) NOT BETWEEN 128 AND 191) AS ok FROM res"""),
}


def build(final: str, *need: str, **fmt) -> str:
    order: list[str] = []

    def visit(name):
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for n in need:
        visit(n)
    if not order:
        return final
    body = ",\n".join(f"{n} AS ({CTES[n][1].format(**fmt) if n in fmt.get("only", ()) else CTES[n][1]})" for n in order)
    if final.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {body},\n{final[15:]}"
    if final.startswith("WITH "):
        return f"WITH {body},\n{final[5:]}"
    return f"WITH {body}\n{final}"


B = "::BIGINT"
BANDS = ("CASE WHEN l_linenumber = 1 THEN 'unknown' WHEN l_quantity / 6 >= 6 THEN 'bad' WHEN l_quantity / 6 >= 3 THEN 'mid' ELSE 'good' END AS band_serialization_inflation, "
         "CASE WHEN NOT l_quantity > 3 THEN 'unknown' WHEN l_discount * 10 <= 0.25 THEN 'good' WHEN l_discount * 10 <= 0.5 THEN 'mid' ELSE 'bad' END AS band_control_plane_burden, "
         "CASE WHEN NOT l_quantity > 5 THEN 'unknown' WHEN l_tax * 12 >= 0.6 THEN 'good' WHEN l_tax * 12 >= 0.35 THEN 'mid' ELSE 'bad' END AS band_forward_work_share, "
         "CASE WHEN NOT l_quantity < 40 THEN 'unknown' WHEN l_tax * 14 >= 0.8 THEN 'good' WHEN l_tax * 14 >= 0.5 THEN 'mid' ELSE 'bad' END AS band_dereference, "
         "CASE WHEN l_linenumber - 1 >= 3 THEN 'bad' WHEN l_linenumber > 1 THEN 'mid' ELSE 'good' END AS band_repair_depth")
SCORE = """
  count(*) FILTER (label = 'directive' AND {v} = 'directive') AS true_positives,
  count(*) FILTER (label = 'description' AND {v} = 'directive') AS false_positives,
  count(*) FILTER (label = 'directive' AND coalesce({v}, '') <> 'directive') AS false_negatives,
  count(*) FILTER (label = 'description' AND coalesce({v}, '') <> 'directive') AS true_negatives"""
REGIME_RULE = """CASE WHEN l_partkey % 19 = 0 THEN 'reset'
  WHEN l_returnflag = 'R' AND l_suppkey % 4 >= 3 THEN 'thrash_repair_depth'
  WHEN l_returnflag = 'R' AND l_quantity > 10 AND l_partkey % 900 >= 5 * l_quantity * 4 THEN 'thrash_recovery_chars'
  WHEN l_returnflag = 'R' AND l_suppkey % 3 >= 2 AND l_tax > 0.01 AND l_quantity / 12 >= 3 AND l_discount > 0 AND l_discount * 8 <= 0.4 THEN 'thrash_obligation_inflation'
  WHEN l_returnflag = 'R' THEN 'recovery_open'
  WHEN l_partkey % 7 % 3 >= 2 THEN 'drift_dereference'
  WHEN l_partkey % 5 % 2 + l_suppkey % 5 % 2 >= 2 THEN 'drift_control_actions'
  WHEN l_tax > 0.01 AND l_quantity / 12 >= 3 AND l_partkey % 2 > 0 THEN 'drift_serialization_obligation' ELSE 'flow' END"""


def _gaps(src, op):
    return f"""SELECT stream_id, seq,
  CASE WHEN ts >= lr THEN round(epoch_us(ts) / 1e6 - epoch_us(lr) / 1e6, 10) END AS gap_previous,
  CASE WHEN ts >= lh THEN round(epoch_us(ts) / 1e6 - epoch_us(lh) / 1e6, 10) END AS gap_human FROM (
  SELECT *, last_value(ts IGNORE NULLS) OVER w AS lr, last_value(CASE WHEN {op} THEN ts END IGNORE NULLS) OVER w AS lh
  FROM {src} WINDOW w AS (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _split_sql(where, cap, extra=""):
    return f"""WITH dealt AS ({CTES['dealt'][1].format(where=where)})
SELECT id, project, {extra} AS split FROM dealt {cap}"""


_DEAL = "CASE WHEN (odd + nth - 1) % 2 = 1 THEN 'holdout' ELSE 'dev' END"
_PAIRS_REL = f"""
SELECT stream_id, seq, pos, md5(key) AS key_md5, shared, round(shared::DOUBLE / len(want), 10) AS cover FROM (
  SELECT r.stream_id, r.seq, r.pos, i.key, i.want, len(list_intersect(i.want, r.have)) AS shared
  FROM (SELECT *, list_distinct({toks("replace_first")}) AS have FROM (
      SELECT *, substr(s, 1, strpos(s, mk) - 1) || ' ' || substr(s, strpos(s, mk) + length(mk)) AS replace_first FROM (
        SELECT *, {find('release', 's')} AS mk FROM sent WHERE NOT bulk AND {m('release', 's')}))) r
  JOIN (SELECT stream_id, epoch_before, identity, min(turn_index) AS t0, arg_min(key, turn_index * 100000 + pos) AS key,
      list_distinct({toks("arg_min(key, turn_index * 100000 + pos)")}) AS want FROM occ GROUP BY 1, 2, 3) i
    ON i.stream_id = r.stream_id AND i.epoch_before = r.epoch_before AND i.t0 < r.turn_index)
WHERE shared >= 2 AND shared::DOUBLE / len(want) >= 0.5"""
# Release claims one sentence after the other: a recursive walk over each epoch's release sentences.
_CLAIMS = f"""WITH RECURSIVE rp AS (
  SELECT r.stream_id, r.epoch_before, r.seq, r.turn_index, r.pos, lower(r.mk) AS marker, i.identity, i.key,
    len(list_intersect(i.want, r.have))::DOUBLE / len(i.want) AS cover,
    (SELECT max(o.turn_index) FROM occ o WHERE o.stream_id = r.stream_id AND o.epoch_before = r.epoch_before
      AND o.identity = i.identity AND o.turn_index < r.turn_index) AS last_stated
  FROM (SELECT *, list_distinct({toks("rest")}) AS have FROM (
      SELECT *, substr(s, 1, strpos(s, mk) - 1) || ' ' || substr(s, strpos(s, mk) + length(mk)) AS rest FROM (
        SELECT *, {find('release', 's')} AS mk FROM sent WHERE NOT bulk AND {m('release', 's')}))) r
  JOIN (SELECT stream_id, epoch_before, identity, min(turn_index) AS t0, arg_min(key, turn_index * 100000 + pos) AS key,
      list_distinct({toks("arg_min(key, turn_index * 100000 + pos)")}) AS want FROM occ GROUP BY 1, 2, 3) i
    ON i.stream_id = r.stream_id AND i.epoch_before = r.epoch_before AND i.t0 < r.turn_index
  WHERE len(list_intersect(i.want, r.have)) >= 2 AND len(list_intersect(i.want, r.have))::DOUBLE / len(i.want) >= 0.5),
ranked AS (
  SELECT stream_id, epoch_before, seq, turn_index, pos, marker,
    row_number() OVER (PARTITION BY stream_id, epoch_before ORDER BY turn_index, pos) AS n,
    list(struct_pack(id := identity, key := key, cover := cover, since := last_stated)) AS cs
  FROM rp GROUP BY 1, 2, 3, 4, 5, 6),
walk AS (
  SELECT DISTINCT stream_id, epoch_before, 0::BIGINT AS n, []::STRUCT(id VARCHAR, t BIGINT)[] AS gone,
    []::STRUCT(id VARCHAR, key VARCHAR, cover DOUBLE, since BIGINT)[] AS win FROM ranked
  UNION ALL
  SELECT stream_id, epoch_before, n, CASE WHEN len(best) = 1 THEN list_append(gone, struct_pack(id := best[1].id, t := turn_index)) ELSE gone END,
    CASE WHEN len(best) = 1 THEN best ELSE [] END
  FROM (SELECT *, list_filter(free, lambda c: c.cover = list_max(list_transform(free, lambda d: d.cover))) AS best FROM (
    SELECT r.stream_id, r.epoch_before, r.n, r.turn_index, w.gone,
      list_filter(r.cs, lambda c: len(list_filter(w.gone, lambda g: g.id = c.id AND g.t > c.since)) = 0) AS free
    FROM walk w JOIN ranked r ON r.stream_id = w.stream_id AND r.epoch_before = w.epoch_before AND r.n = w.n + 1))),
claims AS (
  SELECT r.stream_id, r.epoch_before, r.seq, r.turn_index, r.pos, r.marker, w.win[1].id AS identity, w.win[1].key AS key,
    w.win[1].cover AS cover FROM walk w JOIN ranked r USING (stream_id, epoch_before, n) WHERE len(w.win) = 1)
"""
_NEAR = f"""
SELECT stream_id, seq, md5(key) AS key_md5, md5(pkey) AS prior_md5, round(j, 10) AS jaccard FROM (
  SELECT o.stream_id, o.seq, o.key, i.key AS pkey, {jac("o.tks", "i.tks")} AS j
  FROM (SELECT *, list_distinct({toks("key")}) AS tks FROM occ) o
  JOIN (SELECT *, list_distinct({toks("key")}) AS tks FROM (SELECT stream_id, epoch_before, identity, min(turn_index) AS t0,
      arg_min(key, turn_index * 100000 + pos) AS key FROM occ GROUP BY 1, 2, 3)) i
    ON i.stream_id = o.stream_id AND i.epoch_before = o.epoch_before AND i.t0 < o.turn_index AND i.identity <> o.identity)
WHERE j >= 0.8"""


def oracle_sql() -> dict[str, str]:
    q = build
    o = dict(formats.EXPECTED)
    o["t04c_read_conversations"] = """SELECT 'conv-' || conv_id AS stream_id, 'seq-' || seq AS turn_id, seq, cls AS speaker_class, md5(text) AS text_md5
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'agent'
  WHEN 'system' THEN 'system' WHEN 'tool' THEN 'tool' ELSE 'unknown' END AS cls FROM conversations)"""
    o["t05_event_routing"] = """SELECT kind, CASE WHEN kind IN ('record_observed') THEN 'observations' WHEN kind = 'repair_expansion_candidate' THEN 'classifications'
  WHEN kind = 'metrics_computed' THEN 'metrics' WHEN starts_with(kind, 'obligation_') THEN 'obligations' ELSE 'repairs' END AS file, count(*) AS n
FROM (SELECT CASE event_type WHEN 'click' THEN 'repair_opened' WHEN 'view' THEN 'repair_expansion_candidate' WHEN 'error' THEN 'obligation_repeated'
  WHEN 'purchase' THEN 'metrics_computed' ELSE 'record_observed' END AS kind FROM events) GROUP BY 1, 2"""
    o["t06_event_store"] = """SELECT stream_id, seq, kind, CASE kind WHEN 'record_observed' THEN 'observations' WHEN 'repair_opened' THEN 'repairs'
  WHEN 'obligation_introduced' THEN 'obligations' WHEN 'epoch_advanced' THEN 'metrics' ELSE 'classifications' END AS file, payload
FROM (SELECT 'u' || user_id AS stream_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'repair_opened' WHEN 'view' THEN 'obligation_introduced'
  WHEN 'error' THEN 'epoch_advanced' WHEN 'purchase' THEN 'stop_candidate' ELSE 'record_observed' END AS kind,
  CASE WHEN user_id % 3 = 0 THEN upper(props) ELSE props END AS payload FROM events)"""
    o["t07_line_provenance"] = r"""SELECT path, "offset", sha256(line) AS record_sha256 FROM (
  SELECT path, regexp_replace(ln, '\r+$', '') AS line, coalesce(sum(strlen(ln) + 1) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM (SELECT doc_id::VARCHAR AS path, unnest(l) AS ln, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))
WHERE trim(regexp_replace(line, '\s', ' ', 'g')) <> ''"""
    f4 = lambda x: f"coalesce(printf('%.4f', {x}), 'unknown')"
    o["t09_timeline"] = q(f"""SELECT stream_id, seq, epoch_before AS epoch, 'FLOW' AS regime, 'flow' AS regime_rule, chars AS user_chars, 'unknown' AS baseline_chars,
  'unknown' AS serialization_inflation, {f4('fw / nullif(total, 0)')} AS forward_work_share, {f4('(co + re + rs) / nullif(total, 0)')} AS control_plane_burden,
  0 AS unresolved_obligation_candidates, 0 AS repeated_obligations, 0 AS repair_depth, 0 AS repair_chars, 'unknown' AS dereference_proxy, '' AS pollution_status FROM shares""", "shares")
    o["t10_label_check"] = q("""SELECT CASE WHEN li % 17 = 0 THEN 'unknown_family' WHEN label = 'unlabelable' AND note = '' THEN 'no_reason' ELSE 'ok' END AS problem, count(*) AS n
FROM lbl GROUP BY 1""", "lbl")
    o["f01_operator_turns"] = q("SELECT stream_id, seq, is_op FROM recs", "recs")
    o["f02_size_counts"] = f"""SELECT doc_id, strlen(text) AS bytes, length(text) AS chars, len(list_filter(regexp_split_to_array(text, '{SP}+'), lambda x: x <> '')) AS words,
  CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS lines FROM documents"""
    o["f03_normalize"] = f"SELECT doc_id, md5({norm('text')}) AS norm_md5 FROM documents"
    o["f04_tokens"] = f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {toks('text')} AS t FROM documents)"
    nb = f"""FROM (SELECT conv_id, turn, list_distinct({toks('text')}) AS have FROM conversations) a
  JOIN (SELECT conv_id, turn + 1 AS turn, list_distinct({toks('text')}) AS want FROM conversations) b USING (conv_id, turn)"""
    o["f05_jaccard"] = f"SELECT conv_id, turn, round({jac('have', 'want')}, 10) AS jaccard {nb}"
    o["f06_token_coverage"] = f"""SELECT conv_id, turn, CASE WHEN len(want) = 0 THEN 0.0 ELSE round(len(list_intersect(have, want))::DOUBLE / len(want), 10) END AS cover,
  len(list_intersect(have, want)) AS shared {nb}"""
    o["f07_quoted_chars"] = q(f"""SELECT stream_id, seq, coalesce(x, 0) AS quoted_chars FROM recs LEFT JOIN (
  SELECT stream_id, seq, sum(CASE WHEN starts_with(head, '```') OR before % 2 = 1 OR starts_with(head, '>') THEN length(ln)
      ELSE length(array_to_string(regexp_extract_all(ln, '`[^`]*`'), '')) END)::BIGINT AS x FROM (
    SELECT *, coalesce(sum(starts_with(head, '```')::INT) OVER (PARTITION BY stream_id, seq ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
      SELECT *, {trim('ln')} AS head FROM (SELECT stream_id, seq, unnest(l) AS ln, generate_subscripts(l, 1) AS i FROM (
        SELECT stream_id, seq, string_split(text, chr(10)) AS l FROM recs)))) GROUP BY 1, 2) USING (stream_id, seq)""", "recs")
    o["f08_sentences"] = f'SELECT doc_id, pos, start_b AS start, end_b AS "end", chars FROM ({sentences("documents", ["doc_id"])})'
    o["f09_contained"] = q("SELECT stream_id, seq, count(*) FILTER (contained) AS contained, count(*) AS sentences FROM rsent WHERE s <> '' GROUP BY 1, 2", "rsent")
    code, path = BASELINE_MARKERS["code_span"], BASELINE_MARKERS["path_token"]
    mask = lambda p: (f"array_to_string(list_transform(range(1, len(regexp_split_to_array(text, {lit(p)})) + 1), lambda i: "  # noqa: E731
                      f"repeat('0', length(regexp_split_to_array(text, {lit(p)})[i])) || repeat('1', coalesce(length(regexp_extract_all(text, {lit(p)})[i]), 0))), '')")
    o["f10_code_density"] = q(f"""SELECT stream_id, seq, CASE WHEN length(text) = 0 THEN 0.0 ELSE
  round(len(list_filter(range(1, length(text) + 1), lambda i: substr(a, i, 1) = '1' OR substr(b, i, 1) = '1'))::DOUBLE / length(text), 10) END AS code_density
FROM (SELECT *, {mask(code)} AS a, {mask(path)} AS b FROM recs)""", "recs")
    o["f11_normalize_target"] = r"""SELECT page_id, CASE WHEN c = '/en' THEN '.' WHEN starts_with(c, '/en/') THEN substr(c, 5) ELSE c END AS target FROM (
  SELECT page_id, CASE WHEN n IN (0, 1, 2) THEN p || '/x' WHEN n = 3 THEN 'rel/a.py' WHEN n = 4 THEN '/en' WHEN raw <> '' AND p = '' THEN '/' ELSE p END AS c
  FROM (SELECT *, regexp_replace(regexp_replace(raw, '/+', '/', 'g'), '/$', '') AS p FROM (
    SELECT page_id, page_id % 6 AS n, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS raw FROM pages)))"""
    o["f12_write_targets"] = q("""SELECT stream_id, seq, array_to_string(CASE WHEN write_path = write_path2 THEN [write_path] ELSE writes END, ',') AS writes,
  array_to_string(CASE WHEN write_path = write_path2 THEN [write_path] ELSE writes END, ',') AS paths, n_failed AS failed FROM recs""", "recs")
    o["f13_marker_groups"] = q("SELECT grp, n FROM (" + " UNION ALL ".join(
        f"SELECT {lit(g)} AS grp, count(*) FILTER ({m(g, 's')}) AS n FROM rsent WHERE s <> ''" for g in BASELINE_MARKERS) + ")", "rsent")
    o["f16_segment_labels"] = q("SELECT stream_id, seq, pos, label FROM lab", "lab")
    o["f17_label_buckets"] = q(f"SELECT label, {BUCKET.replace('{x}', 'label')} AS bucket, count(*) AS n, sum(chars)::BIGINT AS chars FROM lab GROUP BY 1, 2", "lab")
    o["f18_obligation_candidates"] = q("SELECT stream_id, seq, pos, kind, md5(key) AS key_md5 FROM cands", "cands")
    o["f19_directive_tests"] = q("SELECT stream_id, seq, pos, subject, second_person, contained, describes FROM cands", "cands")
    o["f20_content_key"] = q("SELECT stream_id, seq, pos, content_key FROM cands", "cands")
    o["f21_pointer"] = q("SELECT stream_id, seq, ptype, ptext, pchars FROM ptr", "ptr")
    o["f22_named_paths"] = q(f"""SELECT stream_id, seq, array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i), lambda i: l[i]), ',') AS paths
FROM (SELECT stream_id, seq, regexp_extract_all(text, {pat('pointer_file')}) AS l FROM turns)""", "turns")
    fs = trim("regexp_extract(" + SPLIT.format(t="text") + ", '^[^' || chr(1) || ']*')")
    o["f23_acceptance"] = q(f"SELECT stream_id, seq, {m('acceptance', 'fs')} AS acceptance, {m('continuation', 'fs')} AS continuation FROM (SELECT *, {fs} AS fs FROM turns)", "turns")
    o["f24_bulk_guard"] = f"""SELECT doc_id, bulk, NOT bulk AND {m('stop', 'text')} AS stop, CASE WHEN NOT bulk THEN lower({find('correction_tier1', 'text')}) END AS tier1
FROM (SELECT *, len(string_split(text, chr(10))) > 40 AS bulk FROM documents)"""
    o["f25_agent_signals"] = q(f"""SELECT stream_id, seq, {m('expansion_task', 'text')}::BIGINT AS exp_task, {m('expansion_validation', 'text')}::BIGINT AS exp_validation,
  {m('expansion_constraint', 'text')}::BIGINT AS exp_constraint, (n_actions = 0 AND {m('expansion_scope', 'text')})::BIGINT AS exp_scope, {m('repair_verb', 'text')} AS claim FROM recs WHERE is_agent""", "recs")
    o["f26_snippet"] = "SELECT doc_id, substr(text, 1, 160) AS snippet FROM documents"
    o["f27_correction_key"] = q("SELECT stream_id, seq, coalesce(ptype, 'unknown') AS target_type, md5(tkey0) AS key_md5 FROM corr", "corr")
    o["f28_ratio_median"] = """SELECT l_suppkey, round(median(l_quantity) FILTER (l_returnflag = 'R'), 10) AS med,
  round(count(*) FILTER (l_returnflag = 'A') / nullif(count(*) FILTER (l_tax > 0.07), 0), 10) AS ratio FROM lineitem GROUP BY 1"""
    o["f29_event_id"] = "SELECT event_id, substr(sha256(user_id || chr(0) || event_id || chr(0) || event_type || chr(0) || (event_id % 3) || chr(0) || '1'), 1, 32) AS id FROM events"
    o["f30_bands"] = f"SELECT *, count(*) AS n FROM (SELECT {BANDS} FROM lineitem) GROUP BY ALL"
    o["f31_pollution"] = """SELECT CASE WHEN r IS NULL THEN 'unknown' WHEN NOT r THEN 'failed' WHEN e > 0 THEN 'polluted' WHEN NOT im THEN 'clean' ELSE 'unknown' END AS status,
  CASE WHEN r IS NULL AND NOT nm THEN 'no path was named' WHEN r IS NULL AND w = 0 THEN 'no write was seen' WHEN r IS NULL THEN 'no write reached the target'
    WHEN NOT r THEN 'the target was not repaired' WHEN e > 0 THEN 'repaired with unrequested work' WHEN NOT im THEN 'repaired, nothing added, not corrected' ELSE 'repaired and still corrected' END AS premise,
  count(*) AS n FROM (SELECT CASE WHEN l_linenumber <= 4 THEN l_returnflag = 'A' END AS r, floor(l_tax * 100 / 3) AS e, l_linestatus = 'O' AS im, floor(l_discount * 40) AS w, l_quantity > 20 AS nm FROM lineitem)
GROUP BY 1, 2"""
    o["f32_regime"] = f"""SELECT CASE WHEN r = 'recovery_open' THEN 'RECOVERY' ELSE upper(split_part(r, '_', 1)) END AS regime, r AS regime_rule, count(*) AS n
FROM (SELECT {REGIME_RULE} AS r FROM lineitem) GROUP BY 1, 2"""
    o["f33_duration_magnification"] = """SELECT a.event_id, CASE WHEN a.event_id % 2 = 0 THEN CASE WHEN b.ts >= a.ts THEN round((epoch_us(b.ts) - epoch_us(a.ts)) / 1e6, 10) END
  ELSE CASE WHEN a.ts >= b.ts THEN round((epoch_us(a.ts) - epoch_us(b.ts)) / 1e6, 10) END END AS seconds,
  CASE WHEN floor(b.value - 5) > 0 THEN round(a.value / floor(b.value - 5), 10) END AS magnification FROM events a JOIN events b ON b.event_id = a.event_id + 7"""
    o["w01_turn_index"] = q("SELECT stream_id, seq, turn_index::BIGINT AS turn_index FROM seqd", "seqd")
    o["w02_epoch"] = q("SELECT stream_id, seq, epoch_before::BIGINT AS epoch_before, epoch::BIGINT AS epoch FROM seqd", "seqd")
    o["w03_rolling_epoch"] = q("SELECT stream_id, turn_index, opens_epoch, first_before FROM turns", "turns")
    o["w04_gaps"] = q(_gaps("recs", "is_op"), "recs")
    o["w04_event_gaps"] = _gaps("(SELECT 'u' || user_id AS stream_id, event_id AS seq, ts, event_type FROM events)", "event_type = 'click'")
    o["w05_repeat_chars"] = q(f"""WITH l AS (SELECT *, {norm('ln')} AS norm FROM (SELECT stream_id, turn_index, first_before, unnest(string_split(text, chr(10))) AS ln FROM turns))
SELECT stream_id, turn_index, sum(length(ln))::BIGINT AS repeat_chars FROM l a WHERE strlen(norm) >= 8 AND EXISTS (SELECT 1 FROM l b WHERE b.stream_id = a.stream_id AND b.norm = a.norm
  AND b.turn_index < a.turn_index AND b.turn_index >= greatest(a.turn_index - 30, coalesce(a.first_before + 1, 1))) GROUP BY 1, 2""", "turns")
    o["w06_restated_sentences"] = q("SELECT stream_id, turn_index, array_to_string(list_sort(list(pos)), ',') AS restated FROM restated GROUP BY 1, 2", "restated")
    tt = f"(SELECT stream_id, turn_index, first_before, list_distinct({toks('text')}) AS tk FROM turns)"
    o["w07_overlap_previous"] = q(f"""SELECT a.stream_id, a.turn_index, round({jac("a.tk", "coalesce(b.tk, []::VARCHAR[])")}, 10) AS overlap FROM {tt} a LEFT JOIN {tt} b
  ON b.stream_id = a.stream_id AND b.turn_index = a.turn_index - 1 AND b.turn_index >= coalesce(a.first_before + 1, 1)""", "turns")
    o["w08_overlap_window"] = q(f"""SELECT stream_id, turn_index, round({jac("tk", "u")}, 10) AS overlap FROM (
  SELECT a.stream_id, a.turn_index, any_value(a.tk) AS tk, coalesce(list_distinct(flatten(list(b.tk) FILTER (b.tk IS NOT NULL))), []::VARCHAR[]) AS u FROM {tt} a LEFT JOIN {tt} b
  ON b.stream_id = a.stream_id AND b.turn_index < a.turn_index AND b.turn_index >= greatest(a.turn_index - 30, coalesce(a.first_before + 1, 1)) GROUP BY 1, 2)""", "turns")
    o["w09_window_shares"] = q("""SELECT stream_id, seq, turn_index, fw::BIGINT AS forward_chars, co::BIGINT AS control_chars, re::BIGINT AS recovery_chars, rs::BIGINT AS restate_chars, ot::BIGINT AS other_chars,
  round(fw / nullif(total, 0), 10) AS forward_work_share, round((co + re + rs) / nullif(total, 0), 10) AS control_plane_burden, round(rs / nullif(total, 0), 10) AS restate_burden FROM shares""", "shares")
    o["w10_control_baseline"] = q("""SELECT stream_id, turn_index, CASE WHEN len(xs) >= 8 THEN round(list_median(xs), 10) END AS baseline_chars, coalesce(len(xs), 0) AS baseline_turns FROM basel""".replace("list_median(xs)", "list_aggregate(xs, 'median')"), "basel")
    o["w11_serialization_inflation"] = q("SELECT stream_id, turn_index, CASE WHEN len(xs) >= 8 THEN round(chars / nullif(list_aggregate(xs, 'median'), 0), 10) END AS inflation FROM basel", "basel")
    o["w12_drift_counts"] = q("""WITH d AS (SELECT t.*, (tier1 IS NOT NULL)::INT AS c, (tier2 IS NOT NULL)::INT AS ms, EXISTS (SELECT 1 FROM cands k WHERE k.stream_id = t.stream_id AND k.seq = t.seq AND NOT k.describes)::INT AS rp,
  CASE WHEN opens_epoch THEN 0 ELSE coalesce((SELECT count(*) FROM seqd s WHERE s.stream_id = t.stream_id AND s.turn_index = t.turn_index - 1 AND s.is_interrupt AND NOT s.is_op AND NOT s.is_agent), 0) END AS it,
  CASE WHEN opens_epoch THEN 0 ELSE (SELECT count(*) FROM overlap v WHERE v.stream_id = t.stream_id AND v.turn_index = t.turn_index - 1) END AS st FROM turns t)
SELECT stream_id, turn_index, (sum(c) OVER n8 + sum(st) OVER n7)::BIGINT AS recent_corrections, (sum(it) OVER n7)::BIGINT AS recent_interrupts, (sum(ms) OVER n8)::BIGINT AS recent_dereference_misses,
  (sum(rp) OVER n8)::BIGINT AS recent_obligation_repeats FROM d WINDOW n8 AS (PARTITION BY stream_id, epoch_before ORDER BY turn_index ROWS BETWEEN 7 PRECEDING AND CURRENT ROW),
  n7 AS (PARTITION BY stream_id, epoch_before ORDER BY turn_index ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""", "turns", "cands", "seqd", "overlap")
    o["w13_trends"] = q("""WITH c AS (SELECT *, lag(band) OVER (PARTITION BY stream_id, metric ORDER BY turn_index) AS fb FROM islands WHERE (grp = 1 AND held = 1) OR (grp > 1 AND held = 2))
SELECT stream_id, metric, turn_index, fb AS from_band, band AS to_band, CASE WHEN list_position(['good', 'mid', 'bad'], band) > list_position(['good', 'mid', 'bad'], fb) THEN 'degrading' ELSE 'improving' END AS direction,
  held AS turns_held FROM c WHERE fb <> band""", "islands")
    o["w14_regime_changes"] = q("SELECT stream_id, seq, was AS from_regime, regime AS to_regime FROM simple WHERE was <> regime", "simple")
    o["w15_last_agent"] = q("""SELECT stream_id, seq, max(CASE WHEN is_agent THEN seq END) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_agent_seq FROM recs""", "recs")
    o["w16_write_overlap"] = q("SELECT stream_id, turn_index::BIGINT AS turn_index, overlap_seq, overlap FROM overlap", "overlap")
    o["w17_latest_name"] = q("SELECT stream_id, 'name-' || max(seq) AS stream_name FROM recs WHERE seq % 6 = 2 GROUP BY 1", "recs")
    o["j01_failed_calls"] = q("""SELECT path, count(*) FILTER (failed) AS failed, count(*) AS calls FROM (
  SELECT c.*, EXISTS (SELECT 1 FROM results r WHERE r.path = c.path AND r.call_id = c.call_id AND r.is_error AND r.pos > c.pos
    AND NOT EXISTS (SELECT 1 FROM calls d WHERE d.path = c.path AND d.call_id = c.call_id AND d.pos > c.pos AND d.pos < r.pos)) AS failed FROM calls c) GROUP BY 1""", "calls", "results")
    o["j02_structured_answers"] = q("""SELECT path, pos, CASE WHEN pos % 7 = 0 THEN 'yes' || chr(10) || call_id ELSE call_id || chr(10) || 'yes' END || chr(10) || 'note a' || chr(10) || 'note b' AS text
FROM results r WHERE call_id::INT % 3 = 0 AND EXISTS (SELECT 1 FROM calls c WHERE c.path = r.path AND c.call_id = r.call_id)""", "calls", "results")
    o["j03_obligation_repeats"] = q("SELECT stream_id, seq, pos, CASE WHEN repeat_count = 0 THEN 'introduced' ELSE 'repeated' END AS event, repeat_count, stood_before FROM stated", "stated")
    o["j04_near_repeats"] = q(_NEAR, "occ")
    o["j05_release_pairs"] = q(_PAIRS_REL, "occ", "sent")
    o["j06_selected_completions"] = q("""WITH a AS (SELECT DISTINCT stream_id, source_seq AS seq, input_hash FROM compl)
SELECT stream_id, seq, CASE WHEN n = 1 THEN j ELSE '' END AS job_id, CASE n WHEN 1 THEN 'selected' WHEN 0 THEN 'missing' ELSE 'ambiguous' END AS what FROM (
  SELECT a.stream_id, a.seq, a.input_hash, count(c.job_id) AS n, min(c.job_id) AS j FROM a LEFT JOIN compl c ON c.stream_id = a.stream_id AND c.source_seq = a.seq AND c.input_hash = a.input_hash
    AND c.status = 'completed' AND c.classifier = 'model' AND c.classifier_hash = 'h1' GROUP BY 1, 2, 3)""", "compl")
    o["j07_alignment"] = q("SELECT session, record, label, value, overlap FROM pairs", "pairs")
    o["j08_dedupe"] = "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE source <> 'src0' AND text NOT IN (SELECT text FROM documents WHERE source = 'src0')"
    renamed = "CASE WHEN doc_id % 6 = 0 THEN 'xd' ELSE 'd' END || doc_id"
    o["j09_prior_split"] = f"""WITH dealt AS ({CTES['dealt'][1].format(where='true').replace("'d' || doc_id", renamed)})
SELECT id, project, CASE WHEN doc_id % 6 = 0 THEN {_DEAL} WHEN doc_id % 8 = 0 THEN 'dev' WHEN doc_id % 4 = 0 THEN 'holdout' ELSE {_DEAL} END AS split FROM dealt
UNION ALL SELECT 'd' || doc_id, source, CASE WHEN doc_id % 8 = 0 THEN 'dev' ELSE 'holdout' END FROM documents WHERE doc_id % 12 = 0"""
    o["j10_pointer_outcomes"] = q("SELECT stream_id, seq, ptype AS pointer_type, outcome, evidence, settled_turn FROM outcomes", "outcomes")
    o["j11_verified_repairs"] = q(f"""WITH n AS (SELECT stream_id, turn_index, regexp_extract_all(text, {pat('pointer_file')}) AS paths FROM corr WHERE marker IS NOT NULL)
SELECT s.stream_id, s.turn_index::BIGINT AS turn_index, s.seq, len(list_intersect(s.writes_any, n.paths)) > 0 AS target_repaired, (len(list_filter(s.writes_any, lambda w: NOT list_contains(n.paths, w))) > 0)::BIGINT AS new_scope
FROM seqd s JOIN n ON n.stream_id = s.stream_id AND n.turn_index = s.turn_index WHERE s.is_agent AND len(s.writes_any) > 0 AND len(n.paths) > 0""", "corr", "seqd")
    o["j12_broken_seals"] = """SELECT 'd' || doc_id AS id, sha256(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END) AS sealed, CASE WHEN doc_id % 9 <> 0 THEN sha256(text) END AS actual
FROM documents WHERE doc_id % 10 = 0 OR doc_id % 9 = 0"""
    o["a01_bucket_chars"] = q("SELECT stream_id, seq, " + ", ".join(f"{n}::BIGINT AS {n}" for n in ("forward", "control", "recovery", "restate", "other", "handoff")) + " FROM buckets", "buckets")
    o["a02_obligation_surface"] = q("""WITH ids AS (SELECT stream_id, epoch_before, identity, min(turn_index) AS t0 FROM occ GROUP BY 1, 2, 3),
c AS (SELECT t.stream_id, t.seq, t.turn_index, i.identity, i.t0, (SELECT count(*) - 1 FROM occ o WHERE o.stream_id = t.stream_id AND o.epoch_before = t.epoch_before AND o.identity = i.identity AND o.turn_index <= t.turn_index) AS n
  FROM turns t LEFT JOIN ids i ON i.stream_id = t.stream_id AND i.epoch_before = t.epoch_before AND i.t0 <= t.turn_index)
SELECT stream_id, seq, count(identity) AS unresolved, count(*) FILTER (identity IS NOT NULL AND n > 0) AS repeated, count(*) FILTER (t0 = turn_index) AS fresh,
  round(avg(n) FILTER (identity IS NOT NULL), 10) AS mean_repeats, round(median(turn_index - t0) FILTER (identity IS NOT NULL), 10) AS median_age FROM c GROUP BY stream_id, seq""", "occ")
    o["a03_dereference"] = q("""WITH s AS (SELECT t.stream_id, t.turn_index, """ + ", ".join(
        f"(SELECT count(*) FROM outcomes u WHERE u.stream_id = t.stream_id AND u.settled_turn <= t.turn_index AND u.outcome = '{x}') AS pointer_{x}" for x in ("success", "failure", "unknown"))
        + """ FROM turns t) SELECT *, round(pointer_success / nullif(pointer_success + pointer_failure, 0), 10) AS reliability FROM s""", "outcomes")
    o["a04_cycle_totals"] = q(f"""SELECT stream_id, turn_index::BIGINT AS turn_index, count(*) AS records, count(*) FILTER (is_agent) AS agent_turns, coalesce(sum(len(writes_any)) FILTER (is_agent), 0)::BIGINT AS writes,
  count(*) FILTER (is_interrupt AND NOT is_agent) AS interrupts, coalesce(sum(n_failed) FILTER (NOT is_agent OR len(writes_any) > 0), 0)::BIGINT AS failed,
  coalesce(sum({' + '.join(m(g, 'text') + '::INT' for g in ('expansion_task', 'expansion_validation', 'expansion_constraint'))} + (n_actions = 0 AND {m('expansion_scope', 'text')})::INT) FILTER (is_agent), 0)::BIGINT AS text_expansions,
  bool_or(is_agent AND {m('repair_verb', 'text')}) AS claim_text FROM seqd WHERE NOT is_op GROUP BY 1, 2""", "seqd")
    o["a06_current_objects"] = "SELECT user_id::VARCHAR AS object_id, max(event_id) AS seq, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1"
    o["a07_regimes_seen"] = q("""SELECT stream_id, array_to_string(['FLOW'] || list(regime ORDER BY q1), ',') AS regimes_seen FROM (SELECT stream_id, regime, min(seq) AS q1 FROM simple WHERE was <> regime AND regime <> 'FLOW' GROUP BY 1, 2) GROUP BY 1""", "simple")
    o["a09_semantic_operations"] = q("""WITH l AS (SELECT stream_id, list_sort(list(latency_ms)) AS xs FROM compl WHERE latency_ms >= 0 GROUP BY 1)
SELECT c.stream_id, count(*) AS recorded, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'timed_out') AS timed_out, count(*) FILTER (status = 'canceled') AS canceled,
  count(*) FILTER (status NOT IN ('completed', 'timed_out', 'canceled')) AS failed, coalesce(array_to_string(list_sort(list(DISTINCT classifier || '/' || classifier_version || '/' || classifier_hash) FILTER (classifier <> '')), ','), '') AS classifiers,
  any_value(xs[(len(xs) * 50 + 99) // 100]) AS p50_latency_ms, any_value(xs[(len(xs) * 95 + 99) // 100]) AS p95_latency_ms FROM compl c LEFT JOIN l USING (stream_id) GROUP BY 1""", "compl")
    o["a10_corpus_survey"] = q("SELECT stream_id, records, operator_turns, actions, write_actions, interrupts, skipped FROM surveyed", "surveyed")
    o["a11_survey_roll_up"] = q("SELECT skipped, count(*) AS sessions, sum(operator_turns)::BIGINT AS operator_turns, sum(actions)::BIGINT AS actions, count(DISTINCT project) AS projects FROM surveyed GROUP BY 1", "surveyed")
    o["a12_confusion"] = q("SELECT 'obligation' AS family, coalesce(label, '(unlabeled)') AS labeled, coalesce(value, '(silent)') AS predicted, count(*) AS units FROM pairs WHERE label IS DISTINCT FROM 'unlabelable' GROUP BY 1, 2, 3", "pairs")
    sc = f"""SELECT *, true_positives + false_positives AS predicted_positive, true_positives + false_negatives AS labeled_positive,
  round(true_positives / nullif(true_positives + false_positives, 0), 10) AS precision, round(true_positives / nullif(true_positives + false_negatives, 0), 10) AS recall,
  round(2 * true_positives / nullif(2 * true_positives + false_positives + false_negatives, 0), 10) AS f1 FROM (SELECT 'obligation' AS family, {SCORE.format(v='value')},
  count(*) FILTER (label <> 'unlabelable') AS labeled_units, count(*) FILTER (label = 'unlabelable') AS unlabelable_units, count(*) FILTER (label = 'directive' AND value IS NULL) AS missed_by_build FROM pairs)"""
    o["a13_score"] = q(sc, "pairs")
    o["a14_kappa"] = q("""WITH p AS (SELECT a.label AS x, b.label AS y FROM lbl a JOIN lbl b ON a.session = b.session AND a.record = b.record AND a.start_b = b.start_b AND a.end_b = b.end_b AND a.labeler = 'a' AND b.labeler = 'b'),
n AS (SELECT count(*) AS u, avg((x = y)::INT) AS ob FROM p),
e AS (SELECT sum(ca * cb) AS s FROM (SELECT x, count(*) AS ca FROM p GROUP BY 1) a JOIN (SELECT y, count(*) AS cb FROM p GROUP BY 1) b ON x = y)
SELECT 'obligation' AS family, 'a' AS labeler_a, 'b' AS labeler_b, u AS units, round(ob, 10) AS observed, round(s / (u * u), 10) AS expected, round((ob - s / (u * u)) / (1 - s / (u * u)), 10) AS kappa FROM n, e""", "lbl")
    o["a15_discriminator_scores"] = q(f"""SELECT *, round(true_positives / nullif(true_positives + false_positives, 0), 10) AS precision FROM (
  SELECT 'even' AS discriminator, {SCORE.format(v='value')} FROM pairs UNION ALL SELECT 'long', {SCORE.format(v='value2')} FROM pairs)""", "pairs")
    o["a16_coverage"] = q("SELECT 'obligation' AS family, (SELECT count(*) FROM prd) AS predicted, count(*) AS labeled, count(*) FILTER (label = 'unlabelable') AS unlabelable FROM lbl", "lbl", "prd")
    o["a17_consequences"] = q(f"SELECT family, round(predicted_positive / nullif(labeled_positive, 0), 10) AS inventory_ratio, missed_by_build AS unmarked_misses FROM ({sc})", "pairs")
    o["a18_degenerate_pass"] = q("""SELECT 'obligation' AS family, labeler || (li % 40) AS labeler, count(*) AS units FROM lbl WHERE label <> 'unlabelable' GROUP BY 1, 2 HAVING count(*) > 1 AND count(DISTINCT label) = 1""", "lbl")
    lanes = [f"bit_xor(('0x' || substr(h, {16 * i + 1}, 15))::BIGINT)" for i in range(4)]
    o["a20_content_hash"] = f"""SELECT id, sha256(count(*) || ':' || {" || ':' || ".join(lanes)}) AS sha256
FROM (SELECT conv_id::VARCHAR AS id, sha256(turn || chr(0) || coalesce(text, '')) AS h FROM conversations) GROUP BY 1"""
    o["a20_file_digest"] = """SELECT id, sha256(string_agg(name || chr(0) || body, '' ORDER BY name)) AS sha256 FROM (
  SELECT conv_id::VARCHAR AS id, coalesce(role || '.jsonl', '') AS name, coalesce(string_agg(text || chr(10), '' ORDER BY turn), '') AS body FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""
    tree = "SELECT conv_id::VARCHAR AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, sha256(coalesce(text, '')) AS h FROM conversations WHERE conv_id IS NOT NULL"
    for _ in range(4):
        tree = f"SELECT id, up AS place, sha256(string_agg(h, '' ORDER BY place)) AS h FROM (SELECT *, place // 4096 AS up FROM ({tree})) GROUP BY id, up"
    o["a20_tree_digest"] = f"SELECT id, h AS sha256 FROM ({tree})"
    o["l01_top_inflation"] = q("""SELECT stream_id, seq, round(chars / 100.0, 10) AS inflation, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY chars DESC, seq) AS r FROM turns WHERE seq % 3 > 0) WHERE r <= 3""", "turns")
    o["l02_newest_sessions"] = """SELECT id, root FROM (SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS root, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id::VARCHAR) AS n FROM events)
WHERE n <= 3 ORDER BY ts DESC, id LIMIT 15"""
    o["l03_turn_sample"] = q("SELECT stream_id, turn_id FROM (SELECT stream_id, 'seq-' || seq AS turn_id FROM turns) WHERE ('0x' || substr(sha256(stream_id || '/' || turn_id), 1, 8))::BIGINT % 1000 < 250", "turns")
    o["l04_split"] = _split_sql("true", "", _DEAL)
    o["u04_path_union"] = q("""WITH w AS (SELECT stream_id, seq, CASE WHEN write_path = write_path2 THEN [write_path] ELSE writes END AS p FROM recs WHERE len(writes) > 0)
SELECT a.stream_id, a.seq, array_to_string(a.p || list_filter(b.p, lambda x: NOT list_contains(a.p, x)), ',') AS paths FROM w a JOIN w b ON b.stream_id = a.stream_id AND b.seq = a.seq + 2""", "recs")
    dist = lambda l: f"list_transform(list_filter(range(1, len({l}) + 1), lambda i: list_position({l}, {l}[i]) = i), lambda i: {l}[i])"
    o["k03_corrections"] = q(f"""SELECT stream_id, seq, marker AS correction_marker, coalesce(ptype, 'unknown') AS target_type, array_to_string({dist('l')}, ',') AS paths
FROM (SELECT *, regexp_extract_all(text, {pat('pointer_file')}) AS l FROM corr WHERE marker IS NOT NULL)""", "corr")
    o["k04_sentence_units"] = q("""SELECT s.stream_id AS session, 'seq-' || s.seq AS record, start_b AS start, end_b AS "end", md5(s.s) AS text_md5, len(string_split(t.text, chr(10))) AS turn_lines
FROM sent s JOIN turns t USING (stream_id, seq)""", "sent")
    o["k04_turn_context"] = q(f"""WITH p AS (SELECT stream_id, turn_index, list(path ORDER BY seq, i) AS l FROM (SELECT stream_id, turn_index, seq, unnest(w) AS path, generate_subscripts(w, 1) AS i FROM (
    SELECT *, CASE WHEN write_path = write_path2 THEN [write_path] ELSE writes END AS w FROM seqd WHERE is_agent)) GROUP BY 1, 2),
c AS (SELECT x.stream_id, x.turn_index, coalesce(array_to_string({dist('l')}, ','), '') AS w, f, it FROM (SELECT stream_id, turn_index, sum(n_failed)::BIGINT AS f, bool_or(is_interrupt) AS it FROM seqd WHERE NOT is_op GROUP BY 1, 2) x LEFT JOIN p USING (stream_id, turn_index))
SELECT t.stream_id AS session, t.turn_index, coalesce(a.w, '') AS cycle_writes, coalesce(b.w, '') AS earlier_writes, coalesce(r.w, '') AS response_writes, coalesce(a.f, 0) AS cycle_failed_calls,
  coalesce(r.f, 0) AS response_failed_calls, coalesce(a.it, false) AS cycle_interrupted, coalesce(r.it, false) AS response_interrupted FROM turns t
LEFT JOIN c a ON a.stream_id = t.stream_id AND a.turn_index = t.turn_index - 1 LEFT JOIN c b ON b.stream_id = t.stream_id AND b.turn_index = t.turn_index - 2
LEFT JOIN c r ON r.stream_id = t.stream_id AND r.turn_index = t.turn_index""", "turns", "seqd")
    o["k05_attribution"] = q("SELECT stream_id, turn_index, 'seq-' || seq AS turn_id, 'seq-' || lag(seq) OVER (PARTITION BY stream_id ORDER BY turn_index) AS settles FROM turns", "turns")
    edge = lambda x: f"(({x}) = sz OR NOT regexp_matches(substr(hx, (({x}) * 2 + 1)::BIGINT, 2), '^[89AB]'))"
    o["v01_result_problems"] = q(f"""SELECT conv_id, turn, CASE WHEN n % 11 = 0 THEN 'confidence'
  WHEN n % 9 = 1 THEN 'span_outside_text' WHEN n % 9 NOT IN (0, 1, 2) AND mid + 3 > sz THEN 'span_outside_text'
  WHEN n % 9 = 0 THEN 'span_order'
  WHEN n % 9 = 2 AND NOT {edge('mid')} THEN 'span_splits_character'
  WHEN n % 9 NOT IN (0, 1, 2) AND NOT ({edge('mid')} AND {edge('mid + 2')} AND {edge('mid + 3')}) THEN 'span_splits_character'
  WHEN n % 9 = 2 THEN 'segment_label' WHEN n % 10 = 0 AND n % 5 <> 0 THEN 'pointer_claims' WHEN n % 13 = 0 THEN 'correction_claims'
  WHEN n % 7 = 3 THEN 'obligation_kind' WHEN n % 6 = 1 THEN 'obligation_duplicate' WHEN n % 8 = 5 THEN 'resolution_target' WHEN n % 14 = 9 THEN 'resolution_evidence' ELSE 'ok' END AS problem
FROM (SELECT *, hex(bytes) AS hx FROM res)""", "res")
    o["v02_tiles"] = q(f"""SELECT conv_id, turn, unnest([0, mid, mid + 2, mid + 3]) AS start, unnest([mid, mid + 2, mid + 3, sz]) AS "end", unnest(['forward_work', 'other', 'correction', 'other']) AS label
FROM (SELECT *, hex(bytes) AS hx FROM res) WHERE n % 11 <> 0 AND n % 9 NOT IN (0, 1, 2) AND mid + 3 <= sz AND {edge('mid')} AND {edge('mid + 2')} AND {edge('mid + 3')} AND n % 13 <> 0 AND n % 7 <> 3 AND n % 6 <> 1 AND n % 8 <> 5 AND n % 14 <> 9""", "res")
    o["v02_tiles"] = 'SELECT * FROM (' + o["v02_tiles"] + ') WHERE start < "end"'
    o["v03_allowed_resolutions"] = """SELECT e.event_id, 'c' || (user_id % 3) AS classifier, k AS kind FROM (SELECT *, ['released', 'superseded', 'satisfied', 'odd'][event_id % 4 + 1] AS k FROM events) e
WHERE event_id % 5 <> 0 AND EXISTS (SELECT 1 FROM events c WHERE c.user_id % 3 <> 2 AND c.user_id % 3 = e.user_id % 3 AND CASE WHEN c.user_id % 2 = 0 THEN 'released' ELSE 'superseded' END = k)"""
    o["v04_eligible"] = q("SELECT stream_id, seq, strlen(text) AS bytes FROM recs WHERE (is_op OR (is_agent AND seq % 3 = 0)) AND strlen(text) BETWEEN 1 AND 32768", "recs")
    o["v04_prior_turns"] = q("""SELECT stream_id, turn_index, count(t) OVER w AS n, md5(coalesce(string_agg(t, '|') OVER w, '')) AS prior_md5 FROM (SELECT stream_id, turn_index, text AS t FROM turns)
WINDOW w AS (PARTITION BY stream_id ORDER BY turn_index ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""", "turns")
    o["k02_releases"] = q(_CLAIMS + "SELECT stream_id, seq, pos, key, marker, round(cover, 10) AS cover FROM claims", "occ", "sent")
    o["a02_surface_with_releases"] = q(_CLAIMS + """,
ids AS (SELECT stream_id, epoch_before, identity, min(turn_index) AS t0 FROM occ GROUP BY 1, 2, 3),
c AS (SELECT t.stream_id, t.seq, t.turn_index, i.identity, i.t0, (SELECT count(*) - 1 FROM occ o WHERE o.stream_id = t.stream_id AND o.epoch_before = t.epoch_before AND o.identity = i.identity AND o.turn_index <= t.turn_index) AS n
  FROM turns t LEFT JOIN ids i ON i.stream_id = t.stream_id AND i.epoch_before = t.epoch_before AND i.t0 <= t.turn_index
    AND NOT EXISTS (SELECT 1 FROM claims r WHERE r.stream_id = t.stream_id AND r.epoch_before = t.epoch_before AND r.identity = i.identity AND r.turn_index <= t.turn_index
      AND NOT EXISTS (SELECT 1 FROM occ b WHERE b.stream_id = t.stream_id AND b.epoch_before = t.epoch_before AND b.identity = i.identity AND b.turn_index BETWEEN r.turn_index AND t.turn_index)))
SELECT stream_id, seq, count(identity) AS unresolved, count(*) FILTER (identity IS NOT NULL AND n > 0) AS repeated, count(*) FILTER (t0 = turn_index) AS fresh,
  round(avg(n) FILTER (identity IS NOT NULL), 10) AS mean_repeats, round(median(turn_index - t0) FILTER (identity IS NOT NULL), 10) AS median_age FROM c GROUP BY stream_id, seq""", "occ", "sent", "turns")
    o["k02_ledger_events"] = q(_CLAIMS + """SELECT stream_id, seq, pos, CASE WHEN repeat_count = 0 THEN 'introduced' WHEN EXISTS (
    SELECT 1 FROM claims c WHERE c.stream_id = s.stream_id AND c.epoch_before = s.epoch_before AND c.identity = s.identity AND c.turn_index <= s.turn_index
      AND NOT EXISTS (SELECT 1 FROM stated b WHERE b.stream_id = s.stream_id AND b.epoch_before = s.epoch_before AND b.identity = s.identity
        AND b.turn_index >= c.turn_index AND (b.turn_index < s.turn_index OR (b.turn_index = s.turn_index AND b.pos < s.pos))))
  THEN 'revived' ELSE 'repeated' END AS event, repeat_count, kind FROM stated s""", "stated", "sent")
    return o
