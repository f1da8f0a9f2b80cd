"""Feature-attribution queries: explode, frequency, distinctiveness,
per-step top-k, token top-k, patch scores, hash scorer, explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FT
from ..operators import joins as J
from ..operators import relational as R
from ..operators import sets as S
from ..operators import windows as W
from . import sqlvals
from .catalog import register

FEATS = """
, fx AS (SELECT trace_id, step_id, failure_category,
           CAST(json_extract(circuit_attribution, '$.top_features[*]') AS JSON[]) AS fl FROM feat_annotations),
ff AS (SELECT trace_id, step_id, failure_category, fl, unnest(generate_series(1, len(fl))) AS i FROM fx),
feats AS (SELECT trace_id, step_id, failure_category, CAST(i - 1 AS INT) AS pos,
    CAST(json_extract_string(fl[i], '$.feature_id') AS BIGINT) AS feature_id,
    CAST(json_extract_string(fl[i], '$.activation') AS DOUBLE) AS activation,
    json_extract_string(fl[i], '$.layer') AS layer, 'gpt2-small' AS model,
    nullif(json_extract_string(fl[i], '$.description'), '') AS description FROM ff)"""

ORDER_KEY = "trace_id || step_id || lpad(CAST(pos AS VARCHAR), 4, '0')"


def _feats(fx):
    return FT.explode_features(fx.get("feat_annotations"))


@register("explode_features", ["feat_annotations"], FEATS + """
SELECT trace_id, step_id, pos, feature_id, activation, layer, description FROM feats""")
def q_explode_features(fx):
    """One row per attributed feature of every annotation."""
    return _feats(fx).select("trace_id", "step_id", F.col("pos").cast("int").alias("pos"), "feature_id",
                             "activation", "layer", "description")


@register("feature_frequency", ["feat_annotations"], FEATS + f"""
, per AS (SELECT feature_id, count(*) AS hits,
    arg_max(description, CASE WHEN description IS NOT NULL THEN {ORDER_KEY} END) AS explanation
  FROM feats GROUP BY feature_id),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT trace_id, step_id FROM feats) d)
SELECT feature_id, hits, round(hits / greatest(n, 1), 6) AS share, coalesce(explanation, '') AS explanation
FROM per, n ORDER BY hits DESC, feature_id LIMIT 15""")
def q_feature_frequency(fx):
    """The 15 most frequent features over all annotations."""
    return FT.feature_frequency(_feats(fx), None, 15)


@register("feature_frequency_category", ["feat_annotations"], FEATS + f"""
, f2 AS (SELECT * FROM feats WHERE failure_category = 'loop'),
per AS (SELECT feature_id, count(*) AS hits,
    arg_max(description, CASE WHEN description IS NOT NULL THEN {ORDER_KEY} END) AS explanation
  FROM f2 GROUP BY feature_id),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT trace_id, step_id FROM f2) d)
SELECT feature_id, hits, round(hits / greatest(n, 1), 6) AS share, coalesce(explanation, '') AS explanation
FROM per, n ORDER BY hits DESC, feature_id LIMIT 15""")
def q_feature_frequency_category(fx):
    """The 15 most frequent features of 'loop' annotations."""
    return FT.feature_frequency(_feats(fx), "loop", 15)


@register("feature_distinctiveness", ["feat_annotations"], FEATS + f"""
, per AS (SELECT feature_id, count(CASE WHEN failure_category = 'loop' THEN 1 END) AS hits_in,
    count(CASE WHEN failure_category <> 'loop' THEN 1 END) AS hits_out,
    arg_max(description, CASE WHEN failure_category = 'loop' AND description IS NOT NULL THEN {ORDER_KEY} END)
      AS explanation
  FROM feats GROUP BY feature_id),
a AS (SELECT DISTINCT trace_id, step_id, failure_category FROM feats),
n AS (SELECT count(CASE WHEN failure_category = 'loop' THEN 1 END) AS n_in,
        count(CASE WHEN failure_category <> 'loop' THEN 1 END) AS n_out FROM a),
sc AS (SELECT per.*, ln(((hits_in + 1) / (n_in + 1)) / ((hits_out + 1) / (n_out + 1))) AS score
       FROM per, n WHERE hits_in > 0 AND n_out > 0
       ORDER BY score DESC, feature_id LIMIT 15)
SELECT feature_id, hits_in, hits_out, round(score, 4) AS score, coalesce(explanation, '') AS explanation
FROM sc WHERE score > 0""")
def q_feature_distinctiveness(fx):
    """Features most over-represented in 'loop' annotations vs the rest."""
    return FT.feature_distinctiveness(_feats(fx), "loop", 15)


@register("feature_topk_per_step", ["feat_annotations"], FEATS + """
SELECT trace_id, step_id, feature_id, activation, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY trace_id, step_id ORDER BY activation DESC, feature_id) AS rank
  FROM feats) r WHERE rank <= 3""")
def q_feature_topk_per_step(fx):
    """Top 3 features of each annotated step by activation."""
    t = W.topk_per_group(_feats(fx), ["trace_id", "step_id"], [F.col("activation").desc(), F.col("feature_id")], 3)
    return t.select("trace_id", "step_id", "feature_id", "activation", F.col("rank").cast("bigint").alias("rank"))


@register("activation_share", ["feat_annotations"], FEATS + """
SELECT trace_id, step_id, feature_id,
  round(activation / max(activation) OVER (PARTITION BY trace_id, step_id) * 100, 4) AS share_pct
FROM feats""")
def q_activation_share(fx):
    """Each feature's activation as a percentage of its step's largest."""
    return W.activation_share(_feats(fx), ["trace_id", "step_id"]).select(
        "trace_id", "step_id", "feature_id", "share_pct")


@register("distinct_clusters", ["feat_annotations"], FEATS + """
SELECT DISTINCT model, layer, feature_id FROM feats""")
def q_distinct_clusters(fx):
    """Distinct (model, layer, feature) lookups."""
    return S.distinct_clusters(_feats(fx))


@register("join_feature_explanations", ["feat_annotations", "explanations"], FEATS + r"""
SELECT f.trace_id, f.step_id, f.pos, f.feature_id,
  CASE WHEN regexp_matches(f.layer, '^blocks\.[0-9]+\.hook_')
       THEN regexp_extract(f.layer, '^blocks\.([0-9]+)\.', 1) || '-res-jb' ELSE f.layer END AS layer_slug,
  e.text AS description
FROM feats f LEFT JOIN explanations e ON e.model = f.model AND e.feature_id = f.feature_id
  AND e.layer = CASE WHEN regexp_matches(f.layer, '^blocks\.[0-9]+\.hook_')
                     THEN regexp_extract(f.layer, '^blocks\.([0-9]+)\.', 1) || '-res-jb' ELSE f.layer END""")
def q_join_feature_explanations(fx):
    """Every activation with its feature explanation (layer slug mapped)."""
    f = _feats(fx).drop("description")
    return J.join_feature_explanations(f, fx.get("explanations")).select(
        "trace_id", "step_id", F.col("pos").cast("int").alias("pos"), "feature_id", "layer_slug", "description")


@register("token_feature_topk", ["activations"], """
, per AS (SELECT step, feature, sum(value) AS total, arg_max(token, (value, -token)) AS peak_token
          FROM activations GROUP BY step, feature)
SELECT step, rank, feature, round(total, 4) AS total, peak_token FROM (
  SELECT *, row_number() OVER (PARTITION BY step ORDER BY total DESC, feature) AS rank FROM per) r
WHERE rank <= 5""")
def q_token_feature_topk(fx):
    """Top 5 features per step summed over tokens, with the peak token."""
    return FT.token_feature_topk(fx.get("activations"), 5).withColumn("rank", F.col("rank").cast("bigint"))


@register("patch_scores", ["activations"], """
, c AS (SELECT IDIV_D(step) AS pair, token, feature, value FROM activations WHERE step % 2 = 0),
r AS (SELECT IDIV_D(step) AS pair, token, feature, value FROM activations
      WHERE step % 2 = 1 AND NOT (IDIV_D(step) % 3 = 0 AND token = 9)),
n AS (SELECT c1.pair, least(c1.l, r1.l) AS n FROM
        (SELECT pair, max(token) + 1 AS l FROM c GROUP BY pair) c1
        JOIN (SELECT pair, max(token) + 1 AS l FROM r GROUP BY pair) r1 ON c1.pair = r1.pair),
j AS (SELECT coalesce(c.pair, r.pair) AS pair, coalesce(c.token, r.token) AS token,
        coalesce(c.feature, r.feature) AS feature, abs(coalesce(c.value, 0) - coalesce(r.value, 0)) AS d
      FROM c FULL JOIN r ON c.pair = r.pair AND c.token = r.token AND c.feature = r.feature),
per AS (SELECT j.pair, feature, sum(d) AS score, arg_max(token, (d, -token)) AS peak_token
        FROM j JOIN n ON j.pair = n.pair WHERE token < n.n GROUP BY j.pair, feature)
SELECT pair, rank, feature, round(score, 4) AS score, peak_token FROM (
  SELECT *, row_number() OVER (PARTITION BY pair ORDER BY score DESC, feature) AS rank FROM per) x
WHERE rank <= 5""".replace("IDIV_D(step)", "(step // 2)"))
def q_patch_scores(fx):
    """Clean vs corrupted activation swings per pair of runs, top 5 features."""
    a = fx.get("activations")
    pair = F.expr("step div 2")
    clean = a.filter(F.col("step") % 2 == 0).select(pair.alias("pair"), "token", "feature", "value")
    corr = (a.filter((F.col("step") % 2 == 1) & ~(((F.expr("step div 2") % 3) == 0) & (F.col("token") == 9)))
            .select(pair.alias("pair"), "token", "feature", "value"))
    return FT.patch_scores(clean, corr, 5).withColumn("rank", F.col("rank").cast("bigint"))


PROMPT_SQL = ("array_to_string(list_transform(CAST(json_extract(inputs, '$.messages[*]') AS JSON[]), "
              "lambda m: '[' || coalesce(json_extract_string(m, '$.role'), '?') || '] ' || "
              "json_extract_string(m, '$.content')), chr(10))")


RESPONSE_SQL = ("coalesce(CASE WHEN json_type(outputs, '$.text') = 'VARCHAR' THEN json_extract_string(outputs, '$.text') END, "
                "CASE WHEN json_type(outputs, '$.answer') = 'VARCHAR' THEN json_extract_string(outputs, '$.answer') END, '')")
SPOKEN_SQL = f"""
, a AS (SELECT trace_id, step_id, error, step_index, {PROMPT_SQL} AS prompt, {RESPONSE_SQL} AS response
        FROM ev_steps WHERE kind = 'llm-call')"""


def hash_rows(condition: str) -> str:
    """SQL of the hash scorer over the llm-calls that meet ``condition``."""
    return f"""{SPOKEN_SQL},
h AS (SELECT trace_id, step_id, sha256(trace_id || '::' || step_id || '::' || prompt || '::' || response) AS h
      FROM a WHERE {condition}),
r AS (SELECT trace_id, step_id, h, unnest(generate_series(0, 7)) AS rank FROM h),
hashed AS (SELECT trace_id, step_id, CAST(rank AS BIGINT) AS rank,
  CAST(('0x' || substr(h, CAST((rank * 4) % 32 AS INT) * 2 + 1, 8)) AS BIGINT) % 16384 AS feature_id,
  round(5.0 - rank * (4.5 / 8), 4) AS activation, 'mock.layer.resid_post' AS layer FROM r)"""


ANY_TEXT = "(length(trim(prompt)) > 0 OR length(trim(response)) > 0)"
HASH_SQL = hash_rows(ANY_TEXT) + """
SELECT * FROM hashed"""


@register("hash_features", ["ev_steps"], HASH_SQL)
def q_hash_features(fx):
    """Deterministic hash attribution of every attributable llm-call step."""
    return FT.hash_features(R.attributable(fx.get("ev_steps")))


@register("attributable_steps", ["ev_steps"], f"""
SELECT trace_id, step_id FROM ev_steps
WHERE kind = 'llm-call' AND (length(trim({PROMPT_SQL})) > 0 OR length(trim(coalesce(
  CASE WHEN json_type(outputs, '$.text') = 'VARCHAR' THEN json_extract_string(outputs, '$.text') END, ''))) > 0)""")
def q_attributable_steps(fx):
    """llm-call steps with a prompt or a response to attribute."""
    return R.attributable(fx.get("ev_steps")).select("trace_id", "step_id")


@register("attach_attribution", ["ev_steps", "ev_annotations"], hash_rows("error IS NOT NULL OR step_index = 0") + """,
la AS (SELECT trace_id, step_id, arg_max(failure_category, seq) AS failure_category FROM ev_annotations
       GROUP BY trace_id, step_id),
res AS (SELECT trace_id, step_id, '{"model":"mock","sae":"mock","method":"mock-hash-topk","top_features":[' ||
    string_agg('{"feature_id":' || feature_id || ',"activation":' || CAST(CAST(activation AS DOUBLE) AS VARCHAR) ||
               ',"layer":"' || layer || '"}', ',' ORDER BY rank) || ']}' AS doc
  FROM hashed GROUP BY trace_id, step_id)
SELECT coalesce(la.trace_id, res.trace_id) AS trace_id, coalesce(la.step_id, res.step_id) AS step_id,
  coalesce(la.failure_category, 'other') AS failure_category, res.doc AS circuit_attribution
FROM la FULL JOIN res ON la.trace_id = res.trace_id AND la.step_id = res.step_id""")
def q_attach_attribution(fx):
    """Hash attributions of every failing llm-call and of each trace's
    opening llm-call merged into the annotations: an annotated step gets
    the attribution, an unannotated one a new annotation with category
    'other'."""
    s = fx.get("ev_steps")
    cand = s.filter((F.col("kind") == "llm-call") & (F.col("error").isNotNull() | (F.col("step_index") == 0)))
    res = FT.attribution_json(FT.hash_features(cand))
    a = W.latest_annotations(fx.get("ev_annotations"))
    out = J.attach_attribution(a, res)
    return out.select("trace_id", "step_id", "failure_category", "circuit_attribution")


@register("match_surrogate", ["ev_steps"], f""",
{sqlvals.SAE_ENTRIES}, {sqlvals.SURROGATES},
m AS (SELECT DISTINCT lower(trim(coalesce(json_extract_string(inputs, '$.model'), name))) AS m FROM ev_steps
      WHERE kind = 'llm-call'),
e1 AS (SELECT m, arg_min(label, priority) AS l FROM m JOIN sae_entries ON m = lower(label) GROUP BY m),
e2 AS (SELECT m, arg_min(label, priority) AS l FROM m JOIN sae_entries
         ON strpos(m, lower(model)) > 0 OR strpos(lower(model), m) > 0 GROUP BY m),
e3 AS (SELECT m, arg_min(label, (-length(family), priority)) AS l FROM m JOIN surrogates
         ON strpos(m, family) > 0 GROUP BY m)
SELECT m.m AS model, coalesce(e1.l, e2.l, e3.l, 'gpt2-small') AS surrogate
FROM m LEFT JOIN e1 ON m.m = e1.m LEFT JOIN e2 ON m.m = e2.m LEFT JOIN e3 ON m.m = e3.m
WHERE length(m.m) > 0""")
def q_match_surrogate(fx):
    """Surrogate SAE for every captured model name."""
    s = fx.get("ev_steps").filter(F.col("kind") == "llm-call")
    from ..functions import payload as P
    m = s.select(F.lower(F.trim(F.coalesce(P.fields("inputs", "model")["model"], F.col("name")))).alias("model"))
    return J.match_surrogate(m.distinct().filter(F.length("model") > 0), "model").select("model", "surrogate")
