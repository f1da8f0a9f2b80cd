"""Feature-attribution analytics over annotations.

An annotation may carry ``circuit_attribution`` (JSON text) with a list
``top_features`` of {feature_id, activation, layer, token_position,
description}.  Everything here is table arithmetic over the exploded
features; computing activations (a model forward pass) is out of scope,
except the deterministic hash scorer, which is pure column math.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ATTRIBUTION_DDL = ("model string, sae string, method string, "
                   "top_features array<struct<feature_id:bigint, activation:double, layer:string, "
                   "token_position:bigint, description:string, explanation:string>>")

# Fixed values of the deterministic hash scorer.
HASH_TOP_K = 8
HASH_FEATURE_SPACE = 16384
HASH_LAYER = "mock.layer.resid_post"


def explode_features(annotations: DataFrame, id_cols: tuple[str, ...] = ("trace_id", "step_id")) -> DataFrame:
    """One row per feature of each annotation's attribution, with its
    position in the list (``pos``) and the annotation's category."""
    a = annotations.select(*id_cols, "failure_category",
                           F.from_json("circuit_attribution", ATTRIBUTION_DDL).alias("_a"))
    return (a.filter(F.size("_a.top_features") > 0)
            .select(*id_cols, "failure_category", F.col("_a.model").alias("model"),
                    F.posexplode("_a.top_features").alias("pos", "f"))
            .select(*id_cols, "failure_category", "model", "pos",
                    F.col("f.feature_id").alias("feature_id"), F.col("f.activation").alias("activation"),
                    F.col("f.layer").alias("layer"), F.col("f.token_position").alias("token_position"),
                    F.coalesce(F.nullif(F.col("f.description"), F.lit("")),
                               F.nullif(F.col("f.explanation"), F.lit(""))).alias("description"))
            .filter(F.col("feature_id").isNotNull()))


def feature_frequency(features: DataFrame, category: str | None = None, top_k: int = 15,
                      ann_key: tuple[str, ...] = ("trace_id", "step_id")) -> DataFrame:
    """Most common features (in ``category`` if given): hits (a feature
    repeated inside one annotation counts again), share = hits /
    annotations with features, explanation = last non-empty one seen.
    Top ``top_k`` by hits, feature id breaking ties."""
    f = features if category is None else features.filter(F.col("failure_category") == category)
    order = F.struct(*[F.col(c) for c in ann_key], F.col("pos"))
    per = f.groupBy("feature_id").agg(
        F.count(F.lit(1)).alias("hits"),
        F.max_by("description", F.when(F.col("description").isNotNull(), order)).alias("explanation"))
    n = f.select(*ann_key).distinct().agg(F.count(F.lit(1))).scalar()  # one-row scalar subquery
    top = per.orderBy(F.col("hits").desc(), F.col("feature_id")).limit(top_k)
    return top.select("feature_id", "hits", F.round(F.col("hits") / F.greatest(n, F.lit(1)), 6).alias("share"),
                      F.coalesce("explanation", F.lit("")).alias("explanation"))


def feature_distinctiveness(features: DataFrame, category: str, top_k: int = 15,
                            ann_key: tuple[str, ...] = ("trace_id", "step_id")) -> DataFrame:
    """Features over-represented in ``category`` vs the rest:
    ``ln(((in+1)/(N_in+1)) / ((out+1)/(N_out+1)))`` for features seen in
    the category; top ``top_k`` by score, kept while > 0; round 4.  Empty
    when there is no annotation outside the category."""
    inside = F.col("failure_category") == category
    per = features.groupBy("feature_id").agg(
        F.count(F.when(inside, 1)).alias("hits_in"), F.count(F.when(~inside, 1)).alias("hits_out"),
        F.max_by("description", F.when(inside & F.col("description").isNotNull(),
                                       F.struct(*[F.col(c) for c in ann_key], F.col("pos")))).alias("explanation"))
    anns = features.select(*ann_key, "failure_category").distinct()
    n_in = anns.agg(F.count(F.when(F.col("failure_category") == category, 1))).scalar()
    n_out = anns.agg(F.count(F.when(F.col("failure_category") != category, 1))).scalar()
    s = (per.filter((F.col("hits_in") > 0) & (n_out > 0))
         .withColumn("score", F.log(((F.col("hits_in") + 1) / (n_in + 1))
                                    / ((F.col("hits_out") + 1) / (n_out + 1)))))
    top = s.orderBy(F.col("score").desc(), F.col("feature_id")).limit(top_k).filter(F.col("score") > 0)
    return top.select("feature_id", "hits_in", "hits_out", F.round("score", 4).alias("score"),
                      F.coalesce("explanation", F.lit("")).alias("explanation"))


def token_feature_topk(acts: DataFrame, k: int, step: str = "step") -> DataFrame:
    """Per step: sum activations over tokens per feature, keep the top ``k``
    features (feature id breaks ties) and the token where each peaked."""
    per = acts.groupBy(step, "feature").agg(
        F.sum("value").alias("total"),
        F.max_by("token", F.struct(F.col("value"), -F.col("token"))).alias("peak_token"))
    w = Window.partitionBy(step).orderBy(F.col("total").desc(), F.col("feature"))
    return (per.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(step, "rank", "feature", F.round("total", 4).alias("total"), "peak_token"))


def patch_scores(clean: DataFrame, corrupted: DataFrame, k: int) -> DataFrame:
    """Clean vs corrupted run of each ``pair``: tokens cut to the shorter run,
    score = sum over aligned tokens of |clean - corrupted| per feature
    (a missing activation is 0); top ``k`` per pair and the token with the
    largest swing.  Inputs: (pair, token, feature, value)."""
    def lens(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("pair").agg((F.max("token") + 1).alias(name))

    n = lens(clean, "_lc").join(lens(corrupted, "_lr"), "pair").select(
        "pair", F.least("_lc", "_lr").alias("_n"))
    c = clean.select("pair", "token", "feature", F.col("value").alias("_c"))
    r = corrupted.select("pair", "token", "feature", F.col("value").alias("_r"))
    j = (c.join(r, ["pair", "token", "feature"], "full").join(n, "pair")
         .filter(F.col("token") < F.col("_n"))
         .withColumn("_d", F.abs(F.coalesce("_c", F.lit(0.0)) - F.coalesce("_r", F.lit(0.0)))))
    per = j.groupBy("pair", "feature").agg(
        F.sum("_d").alias("score"), F.max_by("token", F.struct(F.col("_d"), -F.col("token"))).alias("peak_token"))
    w = Window.partitionBy("pair").orderBy(F.col("score").desc(), F.col("feature"))
    return (per.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("pair", "rank", "feature", F.round("score", 4).alias("score"), "peak_token"))


def hash_features(steps: DataFrame, k: int = HASH_TOP_K, space: int = HASH_FEATURE_SPACE) -> DataFrame:
    """Deterministic stand-in scorer: sha256 of
    ``trace::step::prompt::response``; feature i = 4-byte big-endian chunk
    at byte (4 i mod 32) mod ``space``; activation round(5 - i * 4.5 / k, 4)."""
    from ..functions.text import prompt_text, response_text
    s = steps.select("trace_id", "step_id", F.sha2(F.concat_ws(
        "::", F.coalesce("trace_id", F.lit("")), F.coalesce("step_id", F.lit("")),
        prompt_text("inputs"), response_text("outputs")), 256).alias("_h"))
    s = s.select("trace_id", "step_id", "_h", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("rank"))
    chunk = F.expr("substring(_h, pmod(rank * 4, 32) * 2 + 1, 8)")
    fid = F.pmod(F.conv(chunk, 16, 10).cast("bigint"), F.lit(space))
    act = F.bround(F.lit(5.0) - F.col("rank") * F.lit(4.5 / max(1, k)), 4)
    return s.select("trace_id", "step_id", F.col("rank").cast("bigint").alias("rank"),
                    fid.alias("feature_id"), act.alias("activation"), F.lit(HASH_LAYER).alias("layer"))


def attribution_json(hashed: DataFrame, model: str = "mock", sae: str = "mock") -> DataFrame:
    """Per step: the attribution document of the hash scorer (features in
    rank order), ready for ``attach_attribution``."""
    feat = F.struct(F.col("feature_id"), F.col("activation"), F.col("layer"),
                    F.lit(None).cast("bigint").alias("token_position"))
    per = (hashed.groupBy("trace_id", "step_id")
           .agg(F.array_sort(F.collect_list(F.struct("rank", feat.alias("f")))).alias("_l")))
    doc = F.to_json(F.struct(F.lit(model).alias("model"), F.lit(sae).alias("sae"),
                             F.lit("mock-hash-topk").alias("method"),
                             F.transform("_l", lambda x: x["f"]).alias("top_features")))
    return per.select("trace_id", "step_id", doc.alias("attribution"))
