"""Assessment of predictions and claims, verdicts on nodes, provider failures, bounded subgraphs and the evolution of a field.

Null names, reasons and statuses count as empty; ties go by id. Budgets are part of the operators that have them, and what they cut is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators.graph import bfs
from quillgraph.runtime import cut

#: Most seeds of an overview; most levels, nodes and edges of a subgraph; a year that sorts after all others.
OVERVIEW_SEEDS, MOST_DEPTH, MOST_NODES, MOST_EDGES, NO_YEAR = 30, 4, 500, 1000, 9999
#: Classes of a provider's failure by status and words; the first that fits counts.
FAILURES = [
    ("auth", (401, 403), r"\b(401|403|unauthori[sz]ed|forbidden|api key|apikey|credential|auth)\b"), ("rate_limit", (429,), r"\b(429|rate.?limit|too many requests|quota|cooldown)\b"),
    ("bad_query", (400,), r"\b(400|bad request|invalid query|parse|syntax|malformed)\b"), ("not_found", (404,), r"\b(404|not found|no result|missing)\b"),
    ("schema", (), r"\b(schema|json|parse error|invalid response|unexpected token)\b"),
]
NETWORK = r"\b(timeout|timed out|econn|network|fetch|socket|reset|dns|503|502|500)\b"


def _listed(*named: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in named]))


# ---- predictions and observations ---------------------------------------------------------------------------------


def evidence_chain(predictions: DataFrame, observations: DataFrame) -> DataFrame:
    """Adds n, status and target_status to predictions(hypothesis, prediction, role): observed if a valid observation(prediction, run, valid) measures it, unassessable if only others do.

    A hypothesis's targets are observed, partially_observed or not_measured together; not_registered where it has none.
    """
    seen = observations.groupBy("prediction").agg(F.count("*").alias("n"), F.bool_or(F.coalesce("valid", F.lit(False))).alias("any"))
    rows = predictions.join(seen, "prediction", "left").withColumn("status", F.when(F.col("any"), "observed").when(F.col("n") > 0, "unassessable").otherwise("not_measured"))
    target = F.coalesce("role", F.lit("")) == "target"
    g = rows.groupBy("hypothesis").agg(F.count_if(target).alias("targets"), F.count_if(target & (F.col("status") == "observed")).alias("hits"))
    whole = F.when(F.col("targets") == 0, "not_registered").when(F.col("hits") == F.col("targets"), "observed").when(F.col("hits") > 0, "partially_observed").otherwise("not_measured")
    return rows.join(g.select("hypothesis", whole.alias("target_status")), "hypothesis").select("hypothesis", "prediction", "role", F.coalesce("n", F.lit(0)).alias("n"), "status", "target_status")


def proxy_links(proxies: DataFrame, observations: DataFrame) -> DataFrame:
    """Adds runs to proxies(prediction, target): the sorted runs in which both were validly observed. They establish no inference."""
    valid = observations.where("valid").select("prediction", "run").distinct()
    joint = proxies.distinct().join(valid, "prediction").join(valid.withColumnRenamed("prediction", "target"), ["target", "run"])
    runs = joint.groupBy("prediction", "target").agg(F.array_join(F.array_sort(F.collect_list(F.col("run").cast("string"))), ",").alias("runs"))
    return proxies.distinct().join(runs, ["prediction", "target"], "left").select("prediction", "target", F.coalesce("runs", F.lit("")).alias("runs"))


def protocol_status(runs: DataFrame, required: DataFrame, planned: DataFrame, recorded: DataFrame) -> DataFrame:
    """Adds status, mismatches and unknown to runs(run, action), from required(action, field), planned(action, field, value) and recorded(run, field, value)."""
    p, r = planned.select("action", "field", F.col("value").alias("wanted")), recorded.select("run", "field", F.col("value").alias("found"))
    rows = runs.join(required.select("action", "field").distinct(), "action").join(p, ["action", "field"], "left").join(r, ["run", "field"], "left")
    state = F.when(F.col("wanted").isNull() | F.col("found").isNull(), "unknown").when(F.col("wanted") != F.col("found"), "mismatch")
    named = lambda s: F.array_join(F.array_sort(F.collect_set(F.when(F.col("state") == s, F.col("field")))), ",").alias(s)
    g = rows.withColumn("state", state).groupBy("run", "action").agg(named("mismatch"), named("unknown"))
    out = runs.join(g, ["run", "action"], "left").fillna("", ["mismatch", "unknown"])
    return out.withColumn("status", F.when(F.col("mismatch") != "", "mismatch").when(F.col("unknown") != "", "unknown").otherwise("matched"))


def assessed_observations(rows: DataFrame) -> DataFrame:
    """Adds reasons, relation and status to rows of one observation each.

    They have run_status, protocol, action_design, hypothesis_design, reproduced, estimate, lower, upper (the measurement), low, high (what was
    expected), ready, verified, reviewed, confirmatory, necessary. Any reason makes a row unassessable; else the interval lies outside the expected
    range (inconsistent), inside (compatible) or neither. Only a ready, verified and reviewed one weakens, a confirmatory one of a necessary prediction excludes.
    """
    missing = F.col("estimate").isNull()
    open_ = ~missing & (F.col("lower").isNull() | F.col("upper").isNull())
    wrong = ~missing & ~open_ & ((F.col("lower") > F.col("upper")) | (F.col("estimate") < F.col("lower")) | (F.col("estimate") > F.col("upper")))
    differs = lambda c, v: ~F.coalesce(F.col(c) == v, F.lit(False))
    reasons = _listed(
        (differs("run_status", "completed"), "run_not_completed"), (differs("protocol", "matched") & (F.col("protocol") == "mismatch"), "protocol_mismatch"), (differs("protocol", "matched") & differs("protocol", "mismatch"), "protocol_unknown"),
        (differs("action_design", "testable"), "action_design_incomplete"), (differs("hypothesis_design", "testable"), "hypothesis_design_incomplete"), (~F.col("reproduced"), "baseline_not_reproduced"),
        (missing, "missing_measurement"), (open_, "missing_uncertainty_interval"), (wrong, "invalid_measurement_interval"),
    )
    yes = lambda c: F.coalesce(c, F.lit(False))
    out = rows.withColumn("reasons", reasons)
    valid = F.size("reasons") == 0
    apart = (F.col("upper") < F.col("low")) | (F.col("lower") > F.col("high"))
    out = out.withColumn("relation", F.when(valid & apart, "inconsistent").when(valid & (F.col("lower") >= F.col("low")) & (F.col("upper") <= F.col("high")), "compatible").otherwise("inconclusive"))
    weak = (F.col("relation") == "inconsistent") & yes(F.col("verified") & F.col("reviewed"))
    status = F.when(~valid, "unassessable").when(~yes(F.col("ready")), "inconclusive").when(F.col("relation") == "compatible", "compatible").when(weak & yes(F.col("confirmatory") & F.col("necessary")), "excluded_in_scope").when(weak, "weakened_in_scope").otherwise("inconclusive")
    return out.withColumn("status", status)


def performance_claims(rows: DataFrame) -> DataFrame:
    """claim, status, reasons of rows(claim, evidence_role, outcome_role, role, quantity, unit, measured, confirmatory, result, difference, estimate, higher).

    Primary outcomes of targets need a comparison with the original; originals and guardrails must be measured and confirmatory. Then: a gain beside a loss of
    another quantity is a tradeoff; a control that reaches what the original does not is a partial recovery; all reached is an improvement in scope.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    is_ = lambda c, v: yes(F.col(c) == v)
    primary = is_("evidence_role", "target") & is_("outcome_role", "primary")
    original, guard = primary & is_("role", "original"), is_("outcome_role", "guardrail")
    needed = original | guard
    gain = needed & yes(F.col("confirmatory") & F.col("difference")) & yes(F.col("estimate") * F.when(F.col("higher"), 1).otherwise(-1) > 0) & is_("result", "meets_target")
    any_ = lambda c, name: F.bool_or(c).alias(name)
    keyed = rows.groupBy("claim", "quantity", "unit").agg(
        any_(primary, "primary"), any_(original, "original"), any_(original & ~yes(F.col("measured")), "unmeasured"), any_(needed & ~yes(F.col("confirmatory")), "loose"), any_(original & is_("result", "below_target"), "below"),
        any_(primary & is_("role", "control") & is_("result", "meets_target"), "control"), any_(gain, "gain"), any_(needed & is_("result", "below_target"), "loss"), any_(needed & ~is_("result", "meets_target"), "short"),
    )
    g = keyed.groupBy("claim").agg(
        *[any_(F.col(c), c) for c in ("primary", "unmeasured", "loose", "below", "gain", "loss", "short")], any_(F.col("primary") & ~F.col("original"), "lone"), any_(F.col("below") & F.col("control"), "part"), F.count_if(F.col("gain") | F.col("loss")).alias("moved")
    )
    reasons = _listed((~F.col("primary"), "target_outcome_not_registered"), (F.col("lone"), "original_target_comparison_missing"), (F.col("unmeasured"), "target_outcome_not_measured"), (F.col("loose"), "target_evidence_not_confirmatory"))
    both = F.col("gain") & F.col("loss") & (F.col("moved") > 1)
    status = F.when(F.size("reasons") > 0, "not_established").when(both, "tradeoff").when(F.col("part"), "partial_recovery").when(~F.col("short"), "improved_in_scope").when(F.col("below"), "below_target_in_scope").otherwise("inconclusive")
    return g.withColumn("reasons", reasons).select("claim", status.alias("status"), F.array_join("reasons", ",").alias("reasons"))


# ---- verdicts and failures ----------------------------------------------------------------------------------------


def applied_decisions(nodes: DataFrame, edges: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(id, type, name, aliases) and edges(src, dst, type) after decisions(id, place, verdict, name): the last one of a node counts.

    drop takes a node and its edges away; rename gives the decision's name, if it has one, and keeps the old one as an alias; all else keeps. Edges of one kind
    between two nodes become one with their number. Edges whose ends are not there go.
    """
    word = F.lower(F.trim(F.coalesce("verdict", F.lit(""))))
    last = decisions.where("id is not null").groupBy("id").agg(F.max_by(F.struct(F.when(word.isin("drop", "rename"), word).otherwise("keep").alias("verdict"), F.col("name").alias("to")), "place").alias("d")).select("id", "d.*")
    rows = nodes.join(last, "id", "left").where("coalesce(verdict, 'keep') <> 'drop'")
    renamed = (F.col("verdict") == "rename") & (F.coalesce("to", F.lit("")) != "")
    name = F.when(renamed, F.col("to")).otherwise(F.col("name"))
    old = F.coalesce("aliases", F.array().cast("array<string>"))
    aliases = F.filter(F.array_distinct(F.concat(old, F.when(name != F.col("name"), F.array("name")).otherwise(F.array().cast("array<string>")))), lambda x: (x != "") & (x != name))
    out = rows.select("id", "type", name.alias("name"), T.normalize(F.coalesce(name, F.lit(""))).alias("normalized"), aliases.alias("aliases"), F.col("verdict").isNotNull().alias("checked"), F.coalesce("verdict", F.lit("keep")).alias("verdict"))
    live = out.select("id")
    kept = edges.join(live.withColumnRenamed("id", "src"), "src", "left_semi").join(live.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return out, kept.groupBy("src", "dst", "type").agg(F.count("*").alias("n"))


def failure_class(reason: Column, status: Column) -> Column:
    code = F.coalesce(status.cast("int"), F.lit(0))
    text = F.lower(F.trim(F.regexp_replace(F.concat_ws(" ", reason, status.cast("string")), r"\s+", " ")))
    out = None
    for name, codes, words in FAILURES:
        fits = code.isin(list(codes)) | text.rlike(words) if codes else text.rlike(words)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.when((code >= 500) | text.rlike(NETWORK), "network").otherwise("unknown")


def failure_counts(results: DataFrame) -> DataFrame:
    """provider, category, reason, n of the results(provider, ok, reason, status) that failed."""
    reason = F.coalesce(F.nullif("reason", F.lit("")), F.lit("provider-failed"))
    rows = results.where("not ok").select(F.coalesce(F.nullif("provider", F.lit("")), F.lit("unknown")).alias("provider"), failure_class(reason, F.col("status")).alias("category"), reason.alias("reason"))
    return rows.groupBy("provider", "category", "reason").agg(F.count("*").alias("n"))


# ---- subgraphs ----------------------------------------------------------------------------------------------------


def analysis_subgraph(nodes: DataFrame, edges: DataFrame, seeds: list[str] | None = None, depth: int = 2, most_nodes: int = 180, most_edges: int = 350, first: int | None = None, last: int | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Nodes (id, place, depth) and edges around seeds, and why more were left out.

    A walk in the order of a queue: from each node first its papers, then its edges by id, either way. nodes have id, type, year (their own or their
    paper's, null where unknown) and papers; nodes of type Corpus and of other years do not count. Without seeds the walk begins at the first thirty ids.
    Only what the budgets allow (500 nodes and 1,000 edges at most) reaches the driver.
    """
    depth, most_nodes, most_edges = min(depth, MOST_DEPTH), min(most_nodes, MOST_NODES), min(most_edges, MOST_EDGES)
    spark = nodes.sparkSession
    year = F.col("year").isNull() | ((F.col("year") >= (first or 0)) & (F.col("year") <= (last or NO_YEAR)))
    real = nodes.where(F.col("type") != "Corpus")
    if seeds is None:
        seeds = [r["id"] for r in real.select("id").orderBy("id").limit(OVERVIEW_SEEDS).collect()]
    able = real.where(year).select("id", "papers")
    asked = spark.createDataFrame(list(enumerate(dict.fromkeys(seeds))), "place int, id string")
    level = [r["id"] for r in able.join(F.broadcast(asked), "id").orderBy("place").select("id").limit(most_nodes + 1).collect()]  # at most the seeds asked for
    reasons, found = set(), []
    for d in range(depth + 1):
        if len(found) + len(level) > most_nodes:
            reasons.add("maxNodes")
            level = level[: most_nodes - len(found)]
        start = len(found)
        found += [(x, start + i, d) for i, x in enumerate(level)]
        if not level:
            break
        front = F.broadcast(spark.createDataFrame([(x, start + i) for i, x in enumerate(level)], "id string, place int"))  # no more than the budget
        step = lambda near, far: edges.join(front.withColumnRenamed("id", near), near).select(F.col(far).alias("next"), F.struct("place", F.lit(1).alias("kind"), F.lit(0).alias("at"), F.col("id").cast("string").alias("edge")).alias("order"))
        own = able.join(front, "id").select("place", F.posexplode("papers").alias("at", "next")).select("next", F.struct("place", F.lit(0).alias("kind"), "at", F.lit("").alias("edge")).alias("order"))
        out = own.unionByName(step("src", "dst")).unionByName(step("dst", "src")).groupBy("next").agg(F.min("order").alias("order"))
        known = F.broadcast(spark.createDataFrame([(x,) for x, _, _ in found], "next string"))
        fresh = out.join(known, "next", "left_anti").join(able.select(F.col("id").alias("next")), "next", "left_semi")
        if d == depth:
            if fresh.limit(1).count():
                reasons.add("maxDepth")
            break
        level = [r["next"] for r in fresh.orderBy("order").limit(most_nodes - len(found) + 1).collect()]
    kept = spark.createDataFrame(found, "id string, place int, depth int")
    ends = F.broadcast(kept.select("id"))
    inside = edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    if inside.limit(most_edges + 1).count() > most_edges:
        reasons.add("maxEdges")
    return kept, inside.orderBy("id").limit(most_edges), sorted(reasons)


def field_methods(methods: DataFrame, relations: DataFrame, core_papers: DataFrame, core_methods: DataFrame, first: int | None = None, last: int | None = None, depth: int = 2, most_nodes: int = 180) -> tuple[DataFrame, DataFrame]:
    """Methods of a field as (id, year, papers, role, depth), and the relations(id, source, target, type) among them.

    Core are methods(id, year, papers) named in core_methods(id) or owned by a core_papers(id); boundary is what relations reach from them, either way, through
    methods of the years asked for (or of none). A relation against time does not count. At most ``most_nodes`` methods stay, by depth, year and id.
    """
    within = F.col("year").isNull() | ((F.col("year") >= (first or 0)) & (F.col("year") <= (last or NO_YEAR)))
    able = methods.where(within)
    owned = able.select("id", F.explode("papers").alias("paper")).join(core_papers.select(F.col("id").alias("paper")), "paper", "left_semi").select("id")
    core = cut(able.select("id").join(core_methods.select("id").unionByName(owned).distinct(), "id", "left_semi"), "field-core")
    years = able.select("id", "year")
    side = lambda c, y: years.select(F.col("id").alias(c), F.col("year").alias(y))
    held = cut(relations.join(side("source", "y1"), "source").join(side("target", "y2"), "target").where("not coalesce(y1 > y2, false)").select("id", "source", "target", "type"), "field-relations")
    reached = bfs(held.select(F.col("source").alias("src"), F.col("target").alias("dst")), core, depth, "both")
    near = reached.groupBy("id").agg(F.min("depth").cast("int").alias("depth"))
    role = F.when(F.col("depth") == 0, "core").otherwise("boundary")
    rows = able.join(near, "id").select("id", "year", "papers", role.alias("role"), "depth")
    kept = cut(rows.orderBy("depth", F.coalesce("year", F.lit(NO_YEAR)), "id").limit(min(most_nodes, MOST_NODES)), "field-methods")
    ids = kept.select("id")
    return kept, held.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("id", "source", "target", "type")


def turning_points(relations: DataFrame) -> DataFrame:
    """type, method, n: branches (two successors at least), convergences (two predecessors at least), replacements and adaptations that a source reports."""
    fork = lambda near, far, kind: relations.groupBy(F.col(near).alias("method")).agg(F.countDistinct(far).alias("n")).where("n >= 2").select(F.lit(kind).alias("type"), "method", "n")
    told = relations.where(F.col("type").isin("REPLACES_METHOD", "ADAPTS_METHOD")).groupBy(F.when(F.col("type") == "REPLACES_METHOD", "replacement").otherwise("adaptation").alias("type"), F.col("target").alias("method")).agg(F.count("*").alias("n"))
    return fork("source", "target", "branch").unionByName(fork("target", "source", "convergence")).unionByName(told)


def paper_relations(methods: DataFrame, relations: DataFrame) -> DataFrame:
    """source, target, type, n between the papers of related methods that have one paper each; relations inside a paper do not count."""
    one = lambda c, p: methods.where(F.size("papers") == 1).select(F.col("id").alias(c), F.get("papers", F.lit(0)).alias(p))
    rows = relations.join(one("source", "from"), "source").join(one("target", "to"), "target").where("from <> to")
    return rows.groupBy(F.col("from").alias("source"), F.col("to").alias("target"), "type").agg(F.count("*").alias("n"))


def families(methods: DataFrame, relations: DataFrame) -> DataFrame:
    """family, members, mainline of related methods, the largest first; a cycle has no main line. The field's budgets bound what the driver reads."""
    ids = sorted(r["id"] for r in methods.select("id").limit(MOST_NODES).collect())
    edges = sorted({(r["source"], r["target"]) for r in relations.select("source", "target").distinct().limit(MOST_NODES * MOST_NODES).collect()})
    head = {i: i for i in ids}

    def top(i):
        while head[i] != i:
            i = head[i]
        return i

    for a, b in edges:
        head[max(top(a), top(b))] = min(top(a), top(b))
    groups: dict = {}
    for i in ids:
        groups.setdefault(top(i), []).append(i)
    linked = {i for e in edges for i in e}
    rows = []
    for f, members in groups.items():
        if f not in linked:
            continue
        mine = [e for e in edges if top(e[0]) == f]
        left, best, done = {i: sum(b == i for _, b in mine) for i in members}, {i: (i,) for i in members}, 0
        ready = sorted(i for i in members if not left[i])
        while ready:
            i = ready.pop(0)
            done += 1
            for a, b in mine:
                if a == i:
                    best[b] = min(best[b], (*best[i], b), key=lambda p: (-len(p), p))
                    left[b] -= 1
                    if not left[b]:
                        ready = sorted([*ready, b])
        line = min(best.values(), key=lambda p: (-len(p), p)) if done == len(members) else ()
        rows.append((str(f), len(members), ">".join(map(str, line))))
    return methods.sparkSession.createDataFrame(sorted(rows, key=lambda r: (-r[1], r[0])), "family string, members int, mainline string")
