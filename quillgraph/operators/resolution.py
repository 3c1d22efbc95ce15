"""Resolution of search candidates: each joins the first group, in order of creation, that it may merge into, else it opens one.

The groups grow (identifiers, aliases, authors, venues, latest year), so the order counts and the result is that of a loop over all candidates.
A candidate can only join a group through a member that shares an alias (identifier or title) or has a title from .86 on like the
group's first title. Those links split the candidates into components that cannot touch each other, and each is settled in its order, in parallel
with all others. A component of more than ``most`` candidates is settled in rounds of ``most``: a round gets its candidates and those groups
that one of them can join (``reached``), as they stand after the rounds before, so no task holds a component whole.

Links are stars: every alias and every set of title tokens points at its first candidate. Like titles are found among distinct token sets by the
prefix bound: sets of n tokens with Jaccard from .86 on share one of their n - ceil(.86 n) + 1 rarest tokens, sets of up to
six tokens match nothing but themselves, and frequent tokens are hardly ever joined on. Components come from alternating
large and small stars, whose rounds grow with the logarithm of a component.

candidates(idx long, title, ids map<string,string>, year int, authors array<string>, venue, venue_family, venue_packs array<string>, provider, citations long);
idx gives the order and must be unique.

Cases: candidates without title and identifier are left out; null lists are empty; unknown keys of ids are ignored; titles without a content token match by equality alone; missing
years fit all years; a candidate without authors and venue joins by identifiers or exact titles only.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from functools import reduce
from heapq import merge

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import text as T
from quillgraph.runtime import cut

#: Identifiers in the order that names a group; the strong ones; titles from this similarity on may merge; venues likewise.
PREFIXES = {"arxivId": "arxiv", "doi": "doi", "pmid": "pmid", "pmcid": "pmcid", "isbn": "isbn", "issn": "issn"}
STRONG = ("arxivId", "doi", "pmid", "pmcid")
TITLE, VENUE = 0.86, 0.75

STATE = (
    "component long, grp long, title string, norm_title string, class long, raw array<string>, norm array<string>, ids map<string,string>, aliases array<string>, year int, authors array<string>,"
    " author_keys array<string>, venue string, venue_tokens array<string>, venue_family string, venue_packs array<string>, providers array<string>, citations long, members long"
)
SETTLED = "idx long, reason string, confidence string, similarity double, is_state boolean, " + STATE


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest member) of every node that has a link (a, b); by large and small stars in turn."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        then = cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
        mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        done, edges = mark(then) == mark(edges), then
        if done:
            return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def singular(token: Column) -> Column:
    """Plural endings of title tokens off."""
    ies = (F.length(token) > 5) & token.endswith("ies")
    s = (F.length(token) > 4) & token.endswith("s") & ~token.rlike("(ss|is|us)$")
    return F.when(ies, F.concat(F.substring(token, F.lit(1), F.length(token) - 3), F.lit("y"))).when(s, F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token)


def prepared(candidates: DataFrame) -> DataFrame:
    """Candidates with what is compared: normal title, token sets, aliases, author keys."""
    words = lambda c: F.array_sort(F.array_distinct(T.content_tokens(T.normalize(F.coalesce(c, F.lit(""))))))
    df = candidates.select("idx", F.nullif(F.trim("title"), F.lit("")).alias("title"), F.map_filter(F.coalesce("ids", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*PREFIXES) & v.isNotNull() & (v != "")).alias("ids"), F.col("year").cast("int").alias("year"),
        F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), "venue", "venue_family", F.coalesce("venue_packs", F.array().cast("array<string>")).alias("venue_packs"), "provider", F.col("citations").cast("long").alias("citations"))
    df = df.withColumn("norm_title", F.nullif(T.normalize(F.coalesce("title", F.lit(""))), F.lit(""))).where("norm_title is not null or cardinality(ids) > 0")
    df = df.withColumn("raw", F.array_sort(F.array_distinct(T.content_tokens(F.coalesce("norm_title", F.lit("")))))).withColumn("norm", F.array_sort(F.array_distinct(F.transform("raw", singular))))
    arxiv = lambda v: F.regexp_replace(v, r"v\d+$", "")
    value = lambda k, v: F.when(k == "arxivId", arxiv(v)).when((k == "doi") & v.rlike(r"(?i)^10\.48550/arxiv\."), arxiv(F.lower(v))).otherwise(v)
    prefix = F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv])
    named = F.transform(F.map_entries("ids"), lambda e: F.concat(prefix[e["key"]], F.lit(":"), value(e["key"], e["value"])))
    title = F.when(F.col("norm_title").isNotNull(), F.array(F.concat(F.lit("title:"), "norm_title"))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("aliases", F.array_sort(F.array_distinct(F.concat(named, title))))
    last = F.transform("authors", lambda a: F.element_at(F.concat(F.array(F.lit("")), T.content_tokens(T.normalize(F.coalesce(a, F.lit(""))))), -1))
    return df.withColumn("author_keys", F.array_sort(F.array_distinct(F.filter(last, lambda x: x != "")))).withColumn("venue_tokens", words(F.col("venue")))


def like_titles(sets: DataFrame, least: float = TITLE) -> DataFrame:
    """a, b: pairs of distinct token sets (class, tokens) with Jaccard from ``least`` on, each pair once with a < b."""
    sized = sets.withColumn("n", F.size("tokens")).where(F.col("n") >= least * (F.col("n") + 1) - 1e-9).withColumn("_prefix", F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    rows = sized.select("class", "n", "_prefix", F.explode("tokens").alias("token"))
    common = rows.groupBy("token").agg(F.count("*").alias("df"))
    rare = rows.join(common, "token").groupBy("class", "n", "_prefix").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    keyed = rare.select("class", "n", F.posexplode(F.slice("t", F.lit(1), F.col("_prefix").cast("int"))).alias("at", "x")).select("class", "n", "at", "x.token")
    x, y = (keyed.select(F.col("class").alias(s), F.col("n").alias(f"n_{s}"), F.col("at").alias(f"at_{s}"), "token") for s in ("a", "b"))
    # what both sets can still share behind this place must be enough
    still = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    fits = (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-9) & (still >= least / (1 + least) * (F.col("n_a") + F.col("n_b")) - 1e-9)
    pairs = x.join(y, "token").where(fits).select("a", "b").distinct()
    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("class").alias("b"), F.col("tokens").alias("tb")), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    return both.where(shared / (F.size("ta") + F.size("tb") - shared) >= least - 1e-9).select("a", "b")


def _jaccard(a, b) -> float:
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a and b else 0.0


def _similarity(g: dict, c: dict) -> float:
    if not g["norm_title"] or not c["norm_title"]:
        return 0.0
    return 1.0 if g["norm_title"] == c["norm_title"] else max(_jaccard(g["raw"], c["raw"]), _jaccard(g["norm"], c["norm"]))


def _alias(field: str, value: str) -> str:
    if field == "arxivId" or (field == "doi" and value.lower().startswith("10.48550/arxiv.")):
        value = re.sub(r"v\d+$", "", value.lower() if field == "doi" else value)
    return f"{PREFIXES[field]}:{value}"


def evidence(g: dict, c: dict) -> tuple[str, str, float | None] | None:
    """Why a candidate may join a group, how sure that is, and the similarity of titles; None if it may not."""
    mine = {k: _alias(k, v) for k, v in g["ids"].items()}
    other = {k: _alias(k, v) for k, v in c["ids"].items()}
    strong = lambda x: {v for k, v in x.items() if k in STRONG}
    if strong(mine) & strong(other):
        return "strong_identifier_overlap", "strong", None
    conflict = any(mine[k] != other[k] for k in mine.keys() & other.keys())
    if conflict:
        return None
    shared = set(g["aliases"]) & set(c["aliases"])
    bare = lambda x: all(a.startswith("title:") for a in x["aliases"])
    years = g["year"] is None or c["year"] is None or abs(g["year"] - c["year"]) <= 1
    venue = bool(g["venue_family"] and g["venue_family"] == c["venue_family"]) or _jaccard(g["venue_tokens"], c["venue_tokens"]) >= VENUE or bool(set(g["venue_packs"]) & set(c["venue_packs"]))
    second = years and (bool(set(g["author_keys"]) & set(c["author_keys"])) or venue)
    if any(not a.startswith("title:") for a in shared):
        return "identity_alias_overlap", "strong", None
    if shared and (bare(g) or bare(c) or second):
        return "exact_title_with_secondary_evidence", "provisional" if bare(g) or bare(c) else "probable", 1.0
    similarity = _similarity(g, c)
    return ("fuzzy_title_with_secondary_evidence", "probable", similarity) if similarity >= TITLE - 1e-9 and second else None


def _union(a: list, b: list) -> list:
    return list(dict.fromkeys([*a, *b]))


def _newer(field: str, old: str, new: str) -> bool:
    version = lambda v: int((re.search(r"v(\d+)$", v) or [0, 0])[1])
    return field == "arxivId" and _alias(field, old) == _alias(field, new) and version(new) > version(old)


def opened(c: dict) -> dict:
    keep = {k: c[k] for k in ("component", "title", "norm_title", "class", "raw", "norm", "ids", "aliases", "year", "author_keys", "venue", "venue_tokens", "venue_family", "venue_packs", "citations")}
    return {**keep, "grp": c["idx"], "authors": _union([], c["authors"]), "providers": [c["provider"]] if c["provider"] else [], "members": 1}


def joined(g: dict, c: dict) -> None:
    """Let a group grow by a candidate."""
    if not g["norm_title"]:
        g |= {k: c[k] for k in ("norm_title", "class", "raw", "norm")}
    if len(c["title"] or "") > len(g["title"] or ""):
        g["title"] = c["title"]
    for k, v in c["ids"].items():
        if k not in g["ids"] or _newer(k, g["ids"][k], v):
            g["ids"] = {**g["ids"], k: v}
    for k, other in (("aliases", "aliases"), ("authors", "authors"), ("author_keys", "author_keys"), ("venue_packs", "venue_packs")):
        g[k] = _union(g[k], c[other])
    if c["provider"]:
        g["providers"] = _union(g["providers"], [c["provider"]])
    if not g["venue"]:
        g |= {"venue": c["venue"], "venue_tokens": c["venue_tokens"]}
    g["venue_family"] = g["venue_family"] or c["venue_family"]
    g["year"] = max((y for y in (g["year"], c["year"]) if y is not None), default=None)
    g["citations"] = max((n for n in (g["citations"], c["citations"]) if n is not None), default=None)
    g["members"] += 1


def _bits(ids: dict) -> int:
    return sum(1 << i for i, k in enumerate(PREFIXES) if k in ids)


def settle(candidates: list[dict], groups: list[dict]) -> list[tuple[int, int, str, str, float | None]]:
    """Place candidates in their order; ``groups`` (in order of creation) is changed and grows. Returns idx, group, reason, confidence, similarity.

    Groups that a candidate meets by title alone are kept by their kinds of identifiers and year: with a kind in common they share the identifier, and are
    met by that, or they conflict, and years that do not fit are no evidence unless titles are equal and one side has no identifier. Neither kind is looked at."""
    by_id: dict[str, list[int]] = {}
    by_title: dict[object, dict[tuple, list[int]]] = {}
    noted: dict[int, tuple[tuple, set]] = {}

    def note(at: int, aliases: list[str]) -> None:
        g = groups[at]
        sign, keys = (_bits(g["ids"]), g["year"]), {a for a in aliases if a.startswith("title:")} | ({g["class"]} - {None})
        old, had = noted.get(at, (sign, set()))
        if old != sign:
            for key in had:
                held = by_title[key][old]
                del held[bisect_left(held, at)]
            keys, had = keys | had, set()
        for key in keys - had:
            insort(by_title.setdefault(key, {}).setdefault(sign, []), at)
        noted[at] = sign, keys | had
        for key in aliases:
            if not key.startswith("title:") and at not in by_id.setdefault(key, []):
                insort(by_id[key], at)

    for at in range(len(groups)):
        note(at, groups[at]["aliases"])
    out = []
    for c in sorted(candidates, key=lambda c: c["idx"]):
        bits, year = _bits(c["ids"]), c["year"]
        meets = [by_id[a] for a in c["aliases"] if a in by_id]
        for key in [*c["aliases"], *([c["class"]] if c["class"] is not None else []), *c["near"]]:
            for (other, y), held in by_title.get(key, {}).items():
                if not other & bits and (y is None or year is None or abs(y - year) <= 1 or (isinstance(key, str) and not (other and bits))):
                    meets.append(held)
        last = None
        for at in merge(*meets):
            if at != last and (found := evidence(groups[at], c)):
                joined(groups[at], c)
                out.append((c["idx"], groups[at]["grp"], *found))
                break
            last = at
        else:
            at = len(groups)
            groups.append(opened(c))
            out.append((c["idx"], c["idx"], "initial_candidate", "strong" if any(k in STRONG for k in c["ids"]) else "provisional", None))
        note(at, c["aliases"])
    return out


_STATE_NAMES = [x.strip().split(" ")[0] for x in STATE.replace("map<string,string>", "map").split(",")]
_LISTS = ("raw", "norm", "aliases", "authors", "author_keys", "venue_tokens", "venue_packs", "near", "providers")


def _rows(pdf: pd.DataFrame) -> list[dict]:
    out = []
    for row in pdf.to_dict("records"):
        plain = {k: (None if v is pd.NA or isinstance(v, float) and v != v else v) for k, v in row.items()}
        plain |= {k: list(plain[k]) if plain[k] is not None else [] for k in _LISTS if k in plain}
        plain["ids"] = dict(plain["ids"] or {})
        plain |= {k: int(plain[k]) for k in ("idx", "grp", "class", "year", "citations", "members", "component") if plain.get(k) is not None}
        out.append(plain)
    return out


def _round(key: tuple, candidates: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    held = sorted(_rows(groups), key=lambda g: g["grp"])
    held = [{k: g[k] for k in _STATE_NAMES} for g in held]
    placed = settle(_rows(candidates), held)
    blank = dict.fromkeys(_STATE_NAMES)
    rows = [{**blank, "component": key[0], "idx": i, "grp": g, "reason": r, "confidence": c, "similarity": s, "is_state": False} for i, g, r, c, s in placed]
    rows += [{**g, "idx": None, "reason": None, "confidence": None, "similarity": None, "is_state": True} for g in held]
    names = ["idx", "reason", "confidence", "similarity", "is_state", *_STATE_NAMES]
    out = pd.DataFrame(rows, columns=names, dtype=object)
    return out


def reached(now: DataFrame, state: DataFrame) -> DataFrame:
    """component, grp of the groups that candidates of a round can join: all that share an identifier, and of those met by title the first ones.

    Groups that are alike in all that counts as evidence answer alike, and a candidate takes one group, so of such groups as many can be needed as candidates ask.
    A candidate without identifier joins the first group of its title at the latest."""
    bits = reduce(lambda a, b: a + b, [F.when(F.array_contains(F.map_keys("ids"), k), 1 << i).otherwise(0) for i, k in enumerate(PREFIXES)])
    titled = F.col("key").startswith("title:")
    held = state.withColumn("bits", bits).select("component", "grp", "bits", "year", *[F.array_sort(c).alias(c) for c in ("author_keys", "venue_tokens", "venue_packs")], "venue_family", F.explode(F.concat("aliases", F.array_compact(F.array(F.col("class").cast("string"))))).alias("key"))
    first = held.where(titled).groupBy("component", "key").agg(F.min("grp").alias("most"))
    asks = now.withColumn("bits", bits).withColumn("key", F.concat(F.lit("title:"), "norm_title")).join(first, ["component", "key"], "left")
    asks = asks.select("component", "bits", "year", F.when(F.col("bits") == 0, F.col("most")).alias("most"), F.explode(F.concat("aliases", F.transform(F.array_compact(F.concat("near", F.array("class"))), lambda k: k.cast("string")))).alias("key"))
    # counted first: one row a key, and in it one a kind of candidate
    kinds = asks.groupBy("component", "key", "bits", "year").agg(F.count("*").alias("n"), F.max(F.coalesce("most", F.lit(2**63 - 1))).alias("most"))
    wanted = kinds.groupBy("component", "key").agg(F.collect_list(F.struct("bits", "year", "n", "most")).alias("kinds"))
    year = lambda k: F.coalesce(F.abs(F.col("year") - k["year"]) <= 1, F.lit(True))
    open_ = lambda k: (F.col("bits").bitwiseAND(k["bits"]) == 0) & (year(k) | (titled & ((F.col("bits") == 0) | (k["bits"] == 0))))
    met = held.join(wanted, ["component", "key"])
    shared = met.where(titled | F.col("key").rlike("^[0-9]+$")).withColumn("fit", F.filter("kinds", open_))
    shared = shared.where(F.exists("fit", lambda k: F.col("grp") <= k["most"])).withColumn("n", F.aggregate("fit", F.lit(0).cast("long"), lambda n, k: n + k["n"])).drop("kinds", "fit")
    alike = Window.partitionBy("component", "key", "bits", "year", "author_keys", "venue_tokens", "venue_packs", "venue_family").orderBy("grp")
    some = shared.withColumn("at", F.row_number().over(alike)).where("at <= n").select("component", "grp")
    return met.where(~titled & ~F.col("key").rlike("^[0-9]+$")).select("component", "grp").unionByName(some).distinct()


def resolve(candidates: DataFrame, most: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Assignments (idx, grp, reason, confidence, similarity) and groups: grp is the idx of a group's first candidate."""
    df = cut(prepared(candidates.repartition(candidates.sparkSession.sparkContext.defaultParallelism)), "candidates")
    sets = df.where("norm_title is not null").groupBy("raw", "norm").agg(F.min("idx").alias("class"))
    sets = cut(sets, "title-sets")
    named = cut(df.join(sets, ["raw", "norm"], "left").withColumn("class", F.when(F.col("norm_title").isNotNull(), F.col("class"))), "candidates")
    near = like_titles(sets.select("class", F.col("raw").alias("tokens"))).unionByName(like_titles(sets.select("class", F.col("norm").alias("tokens")))).distinct()
    # sets that are one after plural endings are off are alike too
    alike = sets.withColumn("first", F.min("class").over(Window.partitionBy("norm"))).where("first <> class and cardinality(norm) > 0").select(F.col("first").alias("a"), F.col("class").alias("b"))
    near = cut(near.unionByName(alike).distinct(), "like-titles")
    keys = named.select("idx", F.explode("aliases").alias("key"))
    stars = keys.join(keys.groupBy("key").agg(F.min("idx").alias("b")), "key").select(F.col("idx").alias("a"), "b")
    links = stars.unionByName(named.where("class is not null").select(F.col("idx").alias("a"), F.col("class").alias("b"))).unionByName(near)
    parts = components(links)
    ways = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.collect_set("b").alias("near"))
    # classes that share a plural-free set with each other, not only with the first
    group_of = alike.unionByName(alike.select("a", F.col("a").alias("b")).distinct()).groupBy("a").agg(F.collect_set("b").alias("same"))
    same = group_of.select(F.explode("same").alias("a"), "same")
    ways = ways.join(same, "a", "full").select(F.col("a").alias("class"), F.array_distinct(F.concat(F.coalesce("near", F.array().cast("array<long>")), F.coalesce("same", F.array().cast("array<long>")))).alias("near"))
    ready = named.join(parts.withColumnRenamed("node", "idx"), "idx", "left").withColumn("component", F.coalesce("component", "idx")).join(ways, "class", "left").withColumn("near", F.coalesce("near", F.array().cast("array<long>")))
    large = ready.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > most)
    place = F.row_number().over(Window.partitionBy("component").orderBy("idx"))
    ready = cut(ready, "candidates")
    large = cut(large, "large-components")
    first = ready.join(large, "component", "left_anti").withColumn("round", F.lit(0).cast("long"))
    rest = ready.join(large, "component", "left_semi").withColumn("round", F.floor((place - 1) / most))
    ready = cut(first.unionByName(rest), "candidates")
    rounds = ready.agg(F.max("round")).first()[0]
    spark = df.sparkSession
    placed, state = None, spark.createDataFrame([], STATE)
    for r in range((rounds or 0) + 1):
        now = ready.where(F.col("round") == r)
        if r:
            groups = state.join(reached(now, state), ["component", "grp"], "left_semi")
        else:
            groups = state
        done = cut(now.groupBy("component").cogroup(groups.groupBy("component")).applyInPandas(_round, SETTLED), "resolved")
        changed = done.where("is_state").select(*_STATE_NAMES)
        state = cut(state.join(changed.select("component", "grp"), ["component", "grp"], "left_anti").unionByName(changed), "resolved-groups") if rounds else changed
        rows = done.where("not is_state").select("idx", "grp", "reason", "confidence", "similarity")
        placed = rows if placed is None else placed.unionByName(rows)
    canonical = F.coalesce(*[F.when(F.col("ids")[k].isNotNull(), F.concat(F.lit(f"{PREFIXES[k]}:"), F.regexp_replace(F.col("ids")[k], r"v\d+$", "") if k == "arxivId" else F.col("ids")[k])) for k in STRONG], F.concat(F.lit("title:"), "norm_title"))
    groups = state.select("grp", canonical.alias("canonical_id"), "title", "ids", "year", "authors", "venue", "venue_family", "providers", F.size("providers").alias("provider_count"), "citations", "members")
    return placed, groups
