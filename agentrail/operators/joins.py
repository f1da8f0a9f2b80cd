"""Joins between traces, steps, annotations and small dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import payload as P
from .stats import duration_ms, failed_flag


def join_annotation_counts(traces: DataFrame, annotations: DataFrame) -> DataFrame:
    """Traces with their annotation count (0 when none): annotations are
    pre-aggregated per trace before the left join."""
    c = annotations.groupBy("trace_id").agg(F.count(F.lit(1)).alias("annotation_count"))
    return (traces.join(c, "trace_id", "left")
            .withColumn("annotation_count", F.coalesce("annotation_count", F.lit(0)).cast("bigint")))


def first_step_per_id(steps: DataFrame) -> DataFrame:
    """One step per (trace, step_id): the first in file order."""
    cols = [c for c in steps.columns if c not in ("trace_id", "step_id")]
    return (steps.groupBy("trace_id", "step_id")
            .agg(F.min_by(F.struct(*cols), F.col("step_index")).alias("_s"))
            .select("trace_id", "step_id", *[F.col(f"_s.{c}").alias(c) for c in cols]))


#: Words of 64 bits of a key filter: its broadcast table has this many rows at
#: most (some 30 MB), whatever the number of keys.
FILTER_WORDS = 1 << 20


def may_match(rows: DataFrame, keys: DataFrame, on: list[str], words: int = FILTER_WORDS) -> DataFrame:
    """The rows whose key may be one of ``keys``, before they are shuffled.

    The keys' hashes set bits of a bit map of ``words`` 64-bit words; rows whose
    bit is not set are dropped where they are read.  No row of a key is lost;
    another row passes with a chance of (distinct keys) / (64 x words) at most, so
    a join must follow.  With very many keys the filter passes more, and the
    result is the same."""
    def place(part: str) -> Column:
        h = F.pmod(F.xxhash64(*on), F.lit(64 * words))
        return F.shiftright(h, 6) if part == "word" else h.bitwiseAND(F.lit(63)).cast("int")

    word, bits = [next(n for n in (base + "_" * i for i in range(99)) if n not in rows.columns) for base in ("_word", "_bits")]
    found = keys.groupBy(place("word").alias(word)).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), place("bit"))).alias(bits))
    return (rows.withColumn(word, place("word")).join(F.broadcast(found), word)
            .where(F.bit_get(F.col(bits), place("bit")) == 1).select(*rows.columns))


def join_annotated_steps(steps: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotation joined to the first step carrying its id; annotations whose
    step is missing are dropped (inner join).  Steps without an annotation are
    dropped at the scan, so few payloads are shuffled."""
    on = ["trace_id", "step_id"]
    return annotations.join(first_step_per_id(may_match(steps, annotations, on)), on, "inner")


def anti_keep_tagged(traces: DataFrame, annotations: DataFrame) -> DataFrame:
    return traces.join(annotations.select("trace_id"), "trace_id", "left_anti")


def anti_orphan_annotations(annotations: DataFrame, traces: DataFrame) -> DataFrame:
    """Annotations whose trace no longer exists."""
    return annotations.join(traces.select("trace_id"), "trace_id", "left_anti")


def link_parents(steps: DataFrame) -> DataFrame:
    """Each step with its parent's kind and name.  The parent reference is a
    step id or, for adapters that record run ids, ``metadata.langchain_run_id``
    of the parent; both keys are matched (two equi joins, the step id wins).
    Of parents that share an id the first in file order counts, so the result
    has as many rows as ``steps``."""
    md = P.fields("metadata", "langchain_run_id")
    par = steps.select("trace_id", "step_id", "step_index", "kind", "name", md["langchain_run_id"].alias("run_id"))
    by_id = (par.groupBy("trace_id", "step_id")
             .agg(F.min_by(F.struct("kind", "name"), F.struct("step_index", "kind", "name")).alias("_r"))
             .select("trace_id", F.col("step_id").alias("parent_step_id"),
                     F.col("_r.kind").alias("_k1"), F.col("_r.name").alias("_n1")))
    by_run = (par.filter(F.col("run_id").isNotNull())
              .groupBy("trace_id", "run_id").agg(F.min_by(F.struct("kind", "name"), "step_id").alias("_r"))
              .select("trace_id", F.col("run_id").alias("parent_step_id"),
                      F.col("_r.kind").alias("_k2"), F.col("_r.name").alias("_n2")))
    s = steps.join(by_id, ["trace_id", "parent_step_id"], "left").join(
        by_run, ["trace_id", "parent_step_id"], "left")
    return s.select("trace_id", "step_id", "parent_step_id",
                    F.coalesce("_k1", "_k2").alias("parent_kind"),
                    F.coalesce("_n1", "_n2").alias("parent_name"),
                    (F.col("parent_step_id").isNotNull() & F.coalesce("_k1", "_k2").isNull())
                    .alias("dangling"))


def pair_run_events(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Start + end/error events of one run id -> one step.  An unmatched start
    stays open (null end); an end without a start is ignored (left join)."""
    e = ends.groupBy("run_id").agg(
        F.min_by(F.struct("ended_at", "error", "outputs"), "ended_at").alias("_e"))
    return (starts.join(e, "run_id", "left")
            .select("run_id", "trace_id", "kind", "name", "started_at",
                    F.col("_e.ended_at").alias("ended_at"), F.col("_e.error").alias("error"),
                    F.col("_e.outputs").alias("outputs")))


def positional_diff(steps: DataFrame, groups: DataFrame) -> DataFrame:
    """Align 2-4 traces of a comparison group by step position: a position is
    aligned iff every trace has a step there and all share ``kind:name``.
    ``groups`` = (group_id, trace_id)."""
    n = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n"))
    s = (steps.join(groups, "trace_id")
         .select("group_id", "trace_id", "step_index",
                 F.concat_ws(":", "kind", "name").alias("sig")))
    return (s.groupBy("group_id", "step_index")
            .agg(F.count(F.lit(1)).alias("present"), F.countDistinct("sig").alias("signatures"),
                 F.min("sig").alias("sig"))
            .join(n, "group_id")
            .select("group_id", F.col("step_index").cast("bigint").alias("step_index"), "present",
                    ((F.col("present") == F.col("_n")) & (F.col("signatures") == 1)).alias("aligned"),
                    F.when((F.col("present") == F.col("_n")) & (F.col("signatures") == 1), F.col("sig"))
                    .alias("sig")))


def header_diff(traces: DataFrame, steps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Side-by-side header comparison of (left_id, right_id) pairs: name,
    framework, step count, duration and its delta, failed."""
    c = steps.groupBy("trace_id").agg(F.count(F.lit(1)).alias("steps"))
    h = (traces.join(c, "trace_id", "left")
         .select("trace_id", "name", "framework", F.coalesce("steps", F.lit(0)).alias("steps"),
                 F.round(duration_ms(), 3).alias("duration_ms"), failed_flag().alias("failed")))
    l = h.select(*[F.col(x).alias(f"left_{x}") for x in h.columns])
    r = h.select(*[F.col(x).alias(f"right_{x}") for x in h.columns])
    out = (pairs.join(l, pairs["left_id"] == l["left_trace_id"])
           .join(r, pairs["right_id"] == r["right_trace_id"]))
    return out.select(
        "left_id", "right_id", "left_name", "right_name", "left_framework", "right_framework",
        F.col("left_steps").cast("bigint").alias("left_steps"),
        F.col("right_steps").cast("bigint").alias("right_steps"),
        "left_duration_ms", "right_duration_ms",
        F.round(F.col("right_duration_ms") - F.col("left_duration_ms"), 3).alias("delta_ms"),
        "left_failed", "right_failed")


def bulk_delete_split(traces: DataFrame, ids: DataFrame, max_ids: int | None = None) -> DataFrame:
    """Requested ids (``batch_id``, ``req_pos``, ``id``) -> outcome per id.

    With ``max_ids`` set, a batch holding more ids than that is rejected as a
    whole (outcome ``rejected``; its rows are kept); by default no batch is.
    Otherwise each id is trimmed and resolved as a prefix (first match =
    smallest id): blank, invalid or unmatched -> ``not_found``; a trace
    already deleted by an earlier id of the same batch -> ``not_found``;
    else ``deleted``."""
    from .relational import resolve_prefixes
    req = ids.withColumn("_id", F.trim(F.coalesce("id", F.lit(""))))
    too_many = F.lit(False)
    if max_ids is not None:
        req = req.join(ids.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_size")), "batch_id")
        too_many = F.col("_size") > max_ids
    res = resolve_prefixes(traces, req.select(F.col("_id").alias("prefix")).distinct())
    j = req.join(res, req["_id"] == res["prefix"], "left")
    w = Window.partitionBy("batch_id", "trace_id")
    first = F.min("req_pos").over(w)
    hit = (F.length("_id") > 0) & (F.col("matches") >= 1)
    outcome = (F.when(too_many, F.lit("rejected"))
               .when(hit & (F.col("req_pos") == first), F.lit("deleted"))
               .otherwise(F.lit("not_found")))
    return j.select("batch_id", "req_pos", "id", outcome.alias("outcome"),
                    F.when(outcome == "deleted", F.col("trace_id")).alias("trace_id"))


def index_drift(table: DataFrame, files: DataFrame, sample: int = 20,
                threshold: float = 0.25) -> DataFrame:
    """Compare a derived table with the trace ids on disk: counts, phantom
    rows (in table, not on disk), and whether more than ``threshold`` of
    the newest ``sample`` table rows are phantoms (-> rebuild)."""
    on_disk = files.select("trace_id").distinct().withColumn("_disk", F.lit(True))
    t = table.select("trace_id", "started_at").join(on_disk, "trace_id", "left")
    newest = t.orderBy(F.col("started_at").desc_nulls_last(), F.col("trace_id")).limit(sample)
    sampled = newest.agg(F.count(F.lit(1))).scalar()
    sample_phantoms = newest.agg(F.count(F.when(F.col("_disk").isNull(), 1))).scalar()
    disk = files.agg(F.countDistinct("trace_id")).scalar()
    allc = t.agg(F.count(F.lit(1)).alias("table_rows"),
                 F.count(F.when(F.col("_disk").isNull(), 1)).alias("phantoms"))
    return allc.select("table_rows", "phantoms", disk.alias("disk_traces"), sampled.alias("sampled"),
                       sample_phantoms.alias("sample_phantoms"),
                       ((sample_phantoms / F.greatest(sampled, F.lit(1))) > threshold).alias("rebuild"))


#: Rows of a user's list that become one expression; a longer list is joined.
MOST_LITERALS = 1_000


def _literals(df: DataFrame | None, rows: list[tuple], order: list[str]) -> list[tuple] | None:
    """The rows of a list in order of ``priority`` (first column of ``order``):
    a fixed one as it is, a user's if it is short."""
    if df is None:
        return rows
    found = df.select(*order).limit(MOST_LITERALS + 1).collect()
    return [tuple(r)[1:] for r in sorted(found, key=lambda r: r[0])] if len(found) <= MOST_LITERALS else None


def _first(*options: Column) -> Column:
    return F.coalesce(*options, F.lit(None).cast("string"))


def provider_of(host: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The first provider of ``rules`` (label, pattern, strategy) that a host
    name matches: the host or an end of it from a label on is the pattern
    (``suffix``), or it holds the pattern (``contains``).

    Ends of the host are looked up in a dictionary, so a call costs as many
    look-ups as its host has labels, however long the list is."""
    h = F.lower(host)
    ends: dict[str, tuple[int, str]] = {}
    inside = []
    for i, (label, pattern, strategy) in enumerate(rules):
        if strategy == "contains":
            inside.append(F.when(F.instr(h, pattern.lower()) > 0, F.struct(F.lit(i).alias("i"), F.lit(label).alias("label"))))
        else:
            ends.setdefault(pattern.lower(), (i, label))
    found = []
    if ends:
        lookup = F.create_map(*[x for p, (i, label) in ends.items() for x in (F.lit(p), F.struct(F.lit(i).alias("i"), F.lit(label).alias("label")))])
        labels = F.split(h, r"\.")
        found.append(F.transform(F.sequence(F.lit(1), F.size(labels)),
                                 lambda k: F.try_element_at(lookup, F.array_join(F.slice(labels, k, F.size(labels)), "."))))
    if inside:
        found.append(F.array(*inside))
    if not found:
        return F.lit(None).cast("string")
    return F.when(F.length(h) > 0, F.array_min(F.filter(F.concat(*found), lambda x: x.isNotNull()))["label"])


def detect_provider(calls: DataFrame, host_col: str = "host",
                    providers: DataFrame | None = None) -> DataFrame:
    """First matching provider of each host in list order: equal to the
    pattern or ending in ``.pattern`` (``suffix``), or containing it
    (``contains``).

    The list is one expression over each call (``provider_of``): no join.  A
    user's list of more than ``MOST_LITERALS`` rows is joined on the ends of
    the distinct hosts; only its ``contains`` patterns need a nested loop."""
    order = ["priority", "label", "host_pattern", "strategy"]
    rules = _literals(providers, [(p[0], p[1], p[4]) for p in dims.PROVIDERS], order)
    if rules is not None:
        return calls.withColumn("provider", provider_of(F.col(host_col), rules))
    c = calls.withColumn("_h", F.lower(F.col(host_col)))
    hosts = c.select("_h").filter(F.length("_h") > 0).distinct()
    labels = F.split("_h", r"\.")
    ends = hosts.select("_h", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)),
                                                    lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("_end"))
    rest = providers.filter(F.coalesce(F.col("strategy"), F.lit("suffix")) != "contains").withColumn("_end", F.lower("host_pattern"))
    part = dims.bounded(providers.filter(F.col("strategy") == "contains"))
    hits = ends.join(rest, "_end").select("_h", "priority", "label").unionByName(
        hosts.join(part, F.instr(F.col("_h"), F.lower("host_pattern")) > 0).select("_h", "priority", "label"))
    hits = hits.groupBy("_h").agg(F.min_by("label", "priority").alias("provider"))
    return c.join(hits, "_h", "left").drop("_h")


def detect_provider_path(calls: DataFrame, path_col: str = "path",
                         hints: DataFrame | None = None) -> DataFrame:
    """First path hint (in list order) that the path starts with or contains;
    one expression over each call.  A user's list of more than
    ``MOST_LITERALS`` hints is matched once per distinct path."""
    rows = _literals(hints, dims.PATH_HINTS, ["priority", "hint", "provider"])
    path = F.coalesce(F.col(path_col), F.lit(""))
    if rows is not None:
        return calls.withColumn("path_provider", _first(*[F.when(F.instr(path, hint) > 0, F.lit(p)) for hint, p in rows]))
    c = calls.withColumn("_p", path)
    hits = (c.select("_p").distinct().join(dims.bounded(hints), F.instr(F.col("_p"), F.col("hint")) > 0)
            .groupBy("_p").agg(F.min_by("provider", "priority").alias("path_provider")))
    return c.join(hits, "_p", "left").drop("_p")


def match_surrogate(steps: DataFrame, model_col: str = "model",
                    entries: DataFrame | None = None,
                    families: DataFrame | None = None) -> DataFrame:
    """Surrogate SAE label for each captured model: exact label -> registry
    model contained either way -> longest family substring (declaration
    order breaks ties) -> default (first entry).  One expression over each
    step; lists are registries of at most ``MOST_LITERALS`` rows."""
    known = _literals(entries, [(e[0], e[1]) for e in dims.SAE_ENTRIES], ["priority", "label", "model"])
    kin = _literals(families, dims.SURROGATES, ["priority", "family", "label"])
    if known is None or kin is None:
        raise ValueError(f"registries of more than {MOST_LITERALS} rows are not supported")
    m = F.lower(F.trim(F.coalesce(F.col(model_col), F.lit(""))))
    exact = [F.when(m == label.lower(), F.lit(label)) for label, _ in known]
    within = [F.when((F.instr(m, model.lower()) > 0) | (F.instr(F.lit(model.lower()), m) > 0), F.lit(label)) for label, model in known]
    kind = [F.when(F.instr(m, family) > 0, F.lit(label)) for family, label in sorted(kin, key=lambda r: -len(r[0]))]
    return steps.withColumn("surrogate", F.coalesce(F.when(F.length(m) > 0, _first(*exact, *within, *kind)), F.lit(dims.SAE_ENTRIES[0][0])))


def join_feature_explanations(features: DataFrame, explanations: DataFrame) -> DataFrame:
    """Attach a description to every activation: left join on (model, layer,
    feature_id) after de-duplicating the lookups (of several texts for one
    key the least counts); the layer slug ``blocks.N.hook_*`` becomes
    ``N-res-jb``."""
    slug = F.when(F.col("layer").rlike(r"^blocks\.[0-9]+\.hook_"),
                  F.concat(F.regexp_extract("layer", r"^blocks\.([0-9]+)\.", 1), F.lit("-res-jb"))
                  ).otherwise(F.col("layer"))
    f = features.withColumn("layer_slug", slug)
    e = (explanations.groupBy("model", F.col("layer").alias("layer_slug"), "feature_id")
         .agg(F.min("text").alias("description")))
    return f.join(e, ["model", "layer_slug", "feature_id"], "left")


def attach_attribution(annotations: DataFrame, results: DataFrame, force: bool = False) -> DataFrame:
    """Merge attribution results (trace_id, step_id, attribution JSON) into
    annotations: an existing attribution is kept unless ``force``; a result
    without an annotation creates one with category ``other``."""
    r = results.select("trace_id", "step_id", F.col("attribution").alias("_new"))
    j = annotations.join(r, ["trace_id", "step_id"], "full")
    keep_old = F.col("circuit_attribution").isNotNull() & F.lit(not force)
    out = j.withColumn("circuit_attribution",
                       F.when(keep_old, F.col("circuit_attribution"))
                       .otherwise(F.coalesce(F.col("_new"), F.col("circuit_attribution"))))
    out = out.withColumn("failure_category", F.coalesce("failure_category", F.lit("other")))
    return out.drop("_new")
