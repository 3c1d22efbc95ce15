"""Replay suites: evidence found in nested records of any shape, and a table of gates with the reason of each verdict.

A record is one JSON value. It is parsed as VARIANT and exploded level by level until no level is left, so records need no schema and no common shape; each scalar becomes
a row of its path. Everything after that is grouping of such rows: cases by their place in ``cases``, statistical entries by the object that holds a test's numbers,
whatever lists or maps it lies in. Gates are rows too: a suite, a gate, passed or incomplete, and why. A record's rows are spread by their paths, so a suite with millions of cases is no single group until its counts.

Cases: records that are no JSON object fail every gate that asks for something; names are compared without case and marks; of several entries for a metric one that passes is enough; numbers may be
strings; null and empty values count as missing; repeated suites give their gates once a suite, over the rows of all of its records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.runtime import cut

#: Bounds and the tests that count.
P_MOST, LEAST_SAMPLE, LEAST_METRICS, CUTOFF = 0.05, 2, 3, 20
TESTS = r"(?i)\b(paired|bootstrap|wilcoxon|signed[-_ ]?rank|permutation|randomi[sz]ation|mcnemar|sign[-_ ]?test|confidence[-_ ]?interval)\b"
#: Metrics, the family that asks for each, and its other names. The families "story" and "expert" are never asked for by themselves.
METRICS = {
    "must_cite_recall_at_k_improvement": ("must_cite", ("must_cite_recall_at_20_improvement", "recall_at_20_improvement", "recall20_improvement")), "novelty_score_improvement": ("novelty", ("novelty_improvement", "novelty_lift")),
    "claim_grounding_f1_improvement": ("claim_grounding", ("claim_evidence_f1_improvement", "claim_f1_improvement")), "unsupported_claim_rate_reduction": ("claim_grounding", ("unsupported_rate_reduction", "unsupported_claim_reduction")),
    "storyline_trace_coverage_improvement": ("story", ("storyline_coherence_improvement", "story_coherence_improvement")), "historical_score_improvement": ("historical_replay", ("historical_replay_improvement", "future_match_improvement", "review_preference_improvement")),
    "expert_preference_improvement": ("expert", ("reviewer_preference_improvement", "human_preference_improvement")),
}
#: Families of evidence: what names them, the gate that they need, what their cases have.
FAMILIES = {"must_cite": (r"masterset|must[-_ ]?cite", "must_cite_recall_at_k", "must_cite"), "novelty": (r"novbench|rinobench|axiomatic", "novelty_beats_baseline", "novelty"), "claim_grounding": (r"claim[-_ ]?bench|claimcheck", "claim_grounding", "claims"), "historical_replay": (r"openreview|peerread|moprd|\bre2\b|re²", "historical_replay_beats_live_discovery", "case")}
#: Thresholds that a release needs, by family: name and least value (0: must be above).
THRESHOLDS = {"must_cite": [("mustCiteRecallAtKImprovement", 0.1)], "novelty": [("noveltyImprovement", 0.08)], "claim_grounding": [("claimGroundingF1Improvement", 0.1), ("unsupportedClaimRateReduction", 0.0)], "historical_replay": [("historicalReplayImprovement", 0.0), ("minMajorMetricImprovements", 3.0)]}
#: Names of numbers in statistical entries, and keys that hold entries and name none.
NUMBERS = {
    "p": ("p_value", "pvalue", "p"), "low": ("confidence_interval_lower", "confidenceintervallower", "ci_lower", "cilower"), "effect": ("effect_size", "effectsize", "delta", "improvement", "lift", "estimate", "mean_delta", "meandelta"),
    "n": ("sample_size", "samplesize", "n", "case_count", "casecount", "pair_count", "paircount", "paired_sample_count", "pairedsamplecount"),
}
TEXTS = {"test": ("test", "test_type", "testtype", "method", "statistical_test", "statisticaltest"), "metric": ("metric", "metric_id", "metricid", "metric_name", "metricname")}
HOLDERS = ("metrics", "metric_results", "metricresults", "tests", "statistical_tests", "statisticaltests", "results", "evidence", "statistical_significance", "statisticalsignificance", "significance", "statistics")
FIXTURE = r"(?i)\b(fixture|synthetic|mock|mini|toy|dummy)\b"


def plain(c: Column) -> Column:
    """A name without case and marks."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1_$2"), r"([A-Z])([A-Z][a-z])", "$1_$2")), r"[^a-z0-9]+", "_"), F.lit("_"))


def _named(pattern: str, *parts: str) -> Column:
    """Whether a plain name of the path matches; the plain names are made only if the path has one of ``parts``, which every match has."""
    whole = F.lower(F.array_join("path", "\n"))
    return reduce(lambda a, b: a | b, [F.contains(whole, F.lit(x)) for x in parts]) & F.exists("path", lambda k: plain(k).rlike(pattern))


def scalars(records: DataFrame) -> DataFrame:
    """suite, path (keys and places), key (the last name in it), text of every scalar in records(suite, value); null scalars go."""
    spark = records.sparkSession
    level = records.select("suite", F.array().cast("array<string>").alias("path"), F.lit("").alias("key"), F.try_parse_json("value").alias("v")).where("v is not null")
    out = None
    nested = F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")
    while True:
        # told apart where a level is written, so that whatever reads scalars reads texts alone
        text = F.when(~nested, F.try_variant_get("v", "$", "string"))
        level = cut(level.select("suite", "path", "key", text.alias("text"), F.when(nested, F.col("v")).alias("v")), "variant-level")
        found = level.where("text is not null").select("suite", "path", "key", "text")
        out = found if out is None else out.unionByName(found)
        deeper = level.where("v is not null").drop("text")
        if deeper.isEmpty():
            return out
        each = deeper.alias("t").lateralJoin(spark.tvf.variant_explode(F.col("t.v").outer()).alias("x"))
        level = each.select("suite", F.concat("path", F.array(F.coalesce(F.col("x.key"), F.col("x.pos").cast("string")))).alias("path"), F.coalesce("x.key", F.col("t.key")).alias("key"), F.col("x.value").alias("v"))


def _first(names: tuple[str, ...], kind: str) -> Column:
    value = F.col("text").try_cast("double") if kind == "double" else F.nullif(F.trim("text"), F.lit(""))
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name"))
    return F.min_by(value, F.when((rank > 0) & value.isNotNull(), rank))


def entries(rows: DataFrame) -> DataFrame:
    """suite, metric, test, p, low, effect, n, issues of the statistical entries of rows(scalars), whatever holds them."""
    first = F.get("path", F.lit(0))
    inside = rows.where(_named("^(statistical_significance|statistical_tests)$", "statistical") | (F.contains(F.lower(first), F.lit("statistics")) & (plain(first) == "statistics")))
    # an interval's bounds belong to the object around it
    depth = F.size("path")
    last, up = plain(F.element_at("path", -1)), plain(F.get("path", depth - 2))
    interval = up.isin("confidence_interval", "ci") & last.isin("0", "lower", "low")
    named = inside.select("suite", "text", F.when(interval, F.slice("path", 1, depth - 2)).otherwise(F.slice("path", 1, depth - 1)).alias("owner"), F.when(interval, F.lit("ci_lower")).otherwise(last).alias("name"))
    e = named.groupBy("suite", "owner").agg(*[_first(names, "double").alias(c) for c, names in NUMBERS.items()], *[_first(names, "string").alias(c) for c, names in TEXTS.items()])
    keys = F.filter("owner", lambda k: ~k.rlike(r"^[0-9]+$") & ~plain(k).isin(*HOLDERS))
    e = e.withColumn("metric", plain(F.coalesce("metric", F.try_element_at(keys, F.lit(-1))))).where("metric is not null and (test is not null or p is not null or low is not null or effect is not null or n is not null)")
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    issues = F.array_compact(F.array(
        F.when(bad(F.col("test").rlike(TESTS)), F.lit("missing_paired_or_nonparametric_test")), F.when(bad(F.col("n") >= LEAST_SAMPLE), F.lit("sample_size_lt_2")),
        F.when(bad(F.col("effect") > 0), F.lit("effect_size_not_positive")), F.when(bad((F.col("p") <= P_MOST) | F.coalesce(F.col("low") > 0, F.lit(False))) & bad(F.col("low") > 0), F.lit("p_value_or_ci_not_significant")),
    ))
    return e.select("suite", "metric", "test", "p", "low", "effect", "n", issues.alias("issues"))


def significant(found: DataFrame) -> DataFrame:
    """suite, metrics: the metrics that some entry shows."""
    names = {n: m for m, (_, other) in METRICS.items() for n in (m, *other)}
    metric = reduce(lambda c, kv: c.when(F.col("metric") == kv[0], F.lit(kv[1])), names.items(), F.when(F.lit(False), F.lit("")))
    return found.where("cardinality(issues) = 0").select("suite", metric.alias("metric")).where("metric is not null").groupBy("suite").agg(F.array_sort(F.collect_set("metric")).alias("metrics"))


def cases(rows: DataFrame) -> DataFrame:
    """suite, cases and how many of them have a candidate, a baseline, gold of each kind, any gold, and a cutoff."""
    at = lambda i: F.coalesce(F.get("path", F.lit(i)), F.lit(""))
    c = rows.where(at(0) == "cases").select("suite", at(1).alias("case"), at(2).alias("a"), at(3).alias("b"), "text")
    gold = lambda name: F.bool_or((F.col("a") == "gold") & (F.col("b") == name))
    cut = F.bool_or(F.col("a").isin("timeCutoff", "time_cutoff") & F.col("text").try_cast("double").isNotNull())
    one = c.groupBy("suite", "case").agg(F.bool_or(F.col("a") == "candidate").alias("candidate"), F.bool_or(F.col("a") == "baseline").alias("baseline"), gold("must_cite_set").alias("must_cite"), gold("claims").alias("claims"), gold("novelty_certificate").alias("novelty"), cut.alias("cutoff"))
    return one.groupBy("suite").agg(F.count("*").alias("case"), *[F.count_if(x).alias(x) for x in ("candidate", "baseline", "must_cite", "claims", "novelty", "cutoff")], F.count_if(F.col("must_cite") | F.col("claims") | F.col("novelty")).alias("gold"))


def gates(records: DataFrame) -> DataFrame:
    """suite, gate, status, reason for every suite of records(suite, value)."""
    rows = scalars(records)
    at = lambda i: F.coalesce(F.get("path", F.lit(i)), F.lit(""))
    has = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    number = F.col("text").try_cast("double")
    text = F.nullif(F.trim("text"), F.lit(""))
    source = has((at(0) == "dataset") & (F.size("path") == 2) & (at(1) == "source") & text.isNotNull())
    limits = {f"limit_{name}": F.max(F.when((at(0) == "config") & (at(1) == "thresholds") & (at(2) == name), number)) for family in THRESHOLDS.values() for name, _ in family}
    flat = rows.groupBy("suite").agg(
        F.max(F.when((F.size("path") == 1) & (at(0) == "status"), text)).alias("status"), source.alias("source"), has((at(0) == "dataset") & at(1).isin("license_scope", "licenseScope") & text.isNotNull()).alias("license"),
        has(~at(0).isin("cases", "statistical_significance", "statistical_tests", "statistics") & F.col("text").rlike(FIXTURE)).alias("fixture"), F.max(F.when((at(0) == "config") & at(1).isin("primaryCutoff", "primary_cutoff"), number)).alias("cutoff_at"),
        *[has(at(0).isin("dataset", "name", "adapter", "suite", "id") & F.lower("text").rlike(p)).alias(f"family_{f}") for f, (p, _, _) in FAMILIES.items()], *[v.alias(k) for k, v in limits.items()],
        has(_named("holdout", "holdout") & F.lower("text").rlike(r"venue|year|true")).alias("holdout"), has(_named("time_slice|time_split|temporal", "slice", "split", "temporal") & ~F.lower("text").isin("false", "none", "")).alias("slice"),
    )
    # lists of objects: an input's role beside its hash, a gate's name beside its status
    pairs = rows.where(at(0).isin("inputs", "gates") & (F.size("path") == 3)).groupBy("suite", at(0).alias("list"), at(1).alias("i")).agg(*[F.max(F.when(F.col("path")[2].isin(*names), text)).alias(a) for a, names in (("role", ("role",)), ("hash", ("sha256", "hash", "checksum")), ("name", ("name",)), ("state", ("status",)))])
    listed = pairs.groupBy("suite").agg(has((F.col("list") == "inputs") & (F.col("role") == "raw_dataset") & F.col("hash").isNotNull()).alias("raw_hash"), F.collect_set(F.when((F.col("list") == "gates") & (F.col("state") == "passed"), plain(F.col("name")))).alias("passed"))
    all_ = records.select("suite").distinct().join(flat, "suite", "left").join(listed, "suite", "left").join(cases(rows), "suite", "left").join(significant(entries(rows)), "suite", "left")
    yes = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    gate = lambda name: F.array_contains(F.coalesce("passed", F.array().cast("array<string>")), name)
    shown = F.coalesce("metrics", F.array().cast("array<string>"))
    strict = (count("case") > 0) & (count("cutoff") == count("case"))
    ready = {f: yes(f"family_{f}") & (count(of) > 0) & gate(g) & (strict if f == "historical_replay" else F.lit(True)) for f, (_, g, of) in FAMILIES.items()}
    short = lambda f, name, least: F.when(yes(f"family_{f}") & ~F.coalesce(F.col(f"limit_{name}") >= least if least else F.col(f"limit_{name}") > 0, F.lit(False)), F.lit(name))
    limits_missing = F.array_compact(F.array(F.when(yes("family_must_cite") & ~F.coalesce(F.col("cutoff_at") == CUTOFF, F.lit(False)), F.lit("primaryCutoff")), *[short(f, n, v) for f, xs in THRESHOLDS.items() for n, v in xs]))
    stats_missing = F.array_compact(F.array(*[F.when(yes(f"family_{f}") & ~F.array_contains(shown, m), F.lit(m)) for m, (f, _) in METRICS.items() if f in FAMILIES], F.when(yes("family_historical_replay") & (F.size(shown) < LEAST_METRICS), F.lit("major_metric_significance_count"))))
    said = lambda missing: F.array_join(missing, ",")
    table = [
        ("replay_cases_present", count("case") > 0, F.lit("no cases")), ("candidate_packets_present", count("candidate") == count("case"), F.concat(count("case") - count("candidate"), F.lit(" cases without candidate"))),
        ("baseline_packets_present", count("baseline") == count("case"), F.concat(count("case") - count("baseline"), F.lit(" cases without baseline"))), ("gold_labels_present", count("gold") == count("case"), F.concat(count("case") - count("gold"), F.lit(" cases without gold"))),
        ("suite_status_passed", yes(F.col("status") == "passed"), F.concat(F.lit("status "), F.coalesce("status", F.lit("unknown")))), ("dataset_source_present", yes("source"), F.lit("missing dataset source")), ("license_scope_present", yes("license"), F.lit("missing license scope")),
        ("raw_input_hash_present", yes("raw_hash"), F.lit("missing raw dataset input hash")), ("not_fixture_or_synthetic", ~yes("fixture"), F.lit("fixture or synthetic evidence")), ("strict_time_cutoffs_present", strict, F.concat(count("case") - count("cutoff"), F.lit(" cases without cutoff"))),
        ("venue_year_holdout_present", yes("holdout"), F.lit("missing holdout policy")), ("time_slice_policy_present", yes("slice"), F.lit("missing time-slice policy")), ("target_evidence_family_ready", reduce(lambda a, b: a | b, ready.values()), F.lit("no targeted family is ready")),
        ("improvement_thresholds_present", F.size(limits_missing) == 0, said(limits_missing)), ("statistical_significance_present", F.size(stats_missing) == 0, said(stats_missing)),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("gate"), F.when(ok, "passed").otherwise("incomplete").alias("status"), F.when(ok, "").otherwise(why.cast("string")).alias("reason")) for name, ok, why in table])).alias("g")
    return all_.select("suite", each).select("suite", "g.*")
