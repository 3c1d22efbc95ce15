"""Growing groups against the loop over all candidates and all groups."""

import random
import re

import pytest

from quillgraph.operators import resolution as R
from quillgraph.plans.mutation_queries import candidates_of_parts

FIELDS = "idx long, title string, ids map<string,string>, year int, authors array<string>, venue string, venue_family string, venue_packs array<string>, provider string, citations long"
PREFIX = {"arxivId": "arxiv", "doi": "doi", "pmid": "pmid", "pmcid": "pmcid", "isbn": "isbn", "issn": "issn"}


def toks(text):
    from quillgraph.functions.text import STOPWORDS

    return [t for t in norm(text).split() if len(t) > 2 and t not in STOPWORDS]


def norm(text):
    return " ".join(re.sub(r"[^\w\s-]|_", " ", (text or "").lower()).split())


def single(t):
    if len(t) > 5 and t.endswith("ies"):
        return t[:-3] + "y"
    return t[:-1] if len(t) > 4 and t.endswith("s") and not re.search("(ss|is|us)$", t) else t


def jac(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def base(k, v):
    return f"{PREFIX[k]}:{re.sub(r'v[0-9]+$', '', v) if k == 'arxivId' else v}"


def loop(rows):
    """The definition: every candidate looks at every group in turn."""
    groups, out = [], []
    for idx, title, ids, year, authors, venue, family, packs, provider, citations in sorted(rows, key=lambda r: r[0]):
        ids = {k: v for k, v in (ids or {}).items() if v and k in PREFIX}
        t, people = norm(title), {(toks(a) or [""])[-1] for a in authors or []} - {""}
        if not t and not ids:
            continue
        alias = {base(k, v) for k, v in ids.items()} | ({f"title:{t}"} if t else set())
        for g in groups:
            mine, his = ({k: base(k, v) for k, v in x.items()} for x in (ids, g["ids"]))
            strong = any(k in R.STRONG and j in R.STRONG and v == w for k, v in mine.items() for j, w in his.items())
            clash = any(mine[k] != his[k] for k in mine if k in his)
            shared = alias & g["alias"]
            bare = not ids or all(a.startswith("title:") for a in g["alias"])
            near = (g["year"] is None or year is None or abs(g["year"] - year) <= 1) and (bool(people & g["people"]) or bool(family and family == g["family"]) or jac(set(toks(venue)), set(toks(g["venue"]))) >= 0.75 or bool(set(packs or []) & g["packs"]))
            alike = 0 if not t or not g["title"] else 1 if t == g["title"] else max(jac(set(toks(t)), set(toks(g["title"]))), jac({single(x) for x in toks(t)}, {single(x) for x in toks(g["title"])}))
            why = None
            if strong:
                why = "strong_identifier_overlap"
            elif not clash and any(not a.startswith("title:") for a in shared):
                why = "identity_alias_overlap"
            elif not clash and shared and (bare or near):
                why = "exact_title_with_secondary_evidence"
            elif not clash and alike >= 0.86 and near:
                why = "fuzzy_title_with_secondary_evidence"
            if why:
                out.append((idx, g["idx"], why))
                for k, v in ids.items():
                    version = lambda x: int((re.findall(r"v(\d+)$", x) or [0])[0])
                    if k not in g["ids"] or (k == "arxivId" and base(k, v) == base(k, g["ids"][k]) and version(v) > version(g["ids"][k])):
                        g["ids"][k] = v
                g["alias"] |= alias
                g["people"] |= people
                g["packs"] |= set(packs or [])
                g["title"], g["venue"], g["family"] = g["title"] or t, g["venue"] or venue, g["family"] or family
                g["year"] = max((y for y in (g["year"], year) if y is not None), default=None)
                g["n"] += 1
                break
        else:
            groups.append({"idx": idx, "ids": dict(ids), "alias": set(alias), "people": set(people), "packs": set(packs or []), "title": t, "venue": venue, "family": family, "year": year, "n": 1})
            out.append((idx, idx, "initial_candidate"))
    return sorted(out), {g["idx"]: (g["n"], g["year"]) for g in groups}


def made(seed, n):
    r = random.Random(seed)
    base_words = ["neural", "graph", "networks", "learning", "studies", "deep", "sparse", "methods", "protein", "folding", "classes"]
    rows = []
    for i in r.sample(range(10 * n), n):
        w = base_words[:8] if r.random() < 0.6 else r.sample(base_words, 9)
        w = [x[:-1] if x.endswith("s") and r.random() < 0.2 else x for x in w]
        w = w if r.random() < 0.7 else w[:-1]
        r.random() < 0.3 and r.shuffle(w)
        title = r.choice([" ".join(w), " ".join(w).title(), " ".join(w) + "!", None, "", "The of"])
        ids = r.choice([None, {}, {"doi": f"10.1/{r.randint(0, 5)}"}, {"arxivId": f"2001.0{r.randint(0, 3)}v{r.randint(1, 3)}"}, {"pmid": str(r.randint(0, 4)), "doi": f"10.1/{r.randint(0, 5)}"}, {"isbn": str(r.randint(0, 2)), "other": "1"}])
        rows.append((i, title, ids, r.choice([None, 2000, 2001, 2003]), r.choice([None, [], ["Ann Lee"], ["B. Kim", "Ann Lee"], ["C Wu"]]), r.choice([None, "Conf on Graphs"]), r.choice([None, None, "kdd"]), r.choice([None, ["ml"]]), r.choice(["a", "b", None]), r.choice([None, 3])))
    return rows


@pytest.mark.parametrize("seed,most", [(1, 20_000), (2, 7), (3, 1)])
def test_groups_are_those_of_the_loop(spark, seed, most):
    rows = made(seed, 60 if most > 1 else 25)
    want, sizes = loop(rows)
    placed, groups = R.resolve(spark.createDataFrame(rows, FIELDS), most)
    assert sorted((x.idx, x.grp, x.reason) for x in placed.collect()) == want
    assert {x.grp: (x.members, x.year) for x in groups.collect()} == sizes


def test_no_candidates(spark):
    placed, groups = R.resolve(spark.createDataFrame([(1, " ", None, None, None, None, None, None, None, None)], FIELDS))
    assert placed.count() == groups.count() == 0


def test_parts(spark):
    rows = [tuple(x) for x in candidates_of_parts(spark, "/root/testdata/sf0.001").collect()]
    placed, _ = R.resolve(candidates_of_parts(spark, "/root/testdata/sf0.001"))
    want, _ = loop(rows)
    assert sorted((x.idx, x.grp, x.reason) for x in placed.collect()) == want
    assert {w for _, _, w in want} >= {"strong_identifier_overlap", "fuzzy_title_with_secondary_evidence", "initial_candidate"}


def test_like_titles(spark):
    r = random.Random(7)
    sets = {i: sorted(r.sample("abcdefghijkl", r.randint(1, 12))) for i in range(150)}
    sets = {i: s for i, s in sets.items() if s not in [sets[j] for j in range(i)]}
    got = {(x.a, x.b) for x in R.like_titles(spark.createDataFrame(list(sets.items()), "class long, tokens array<string>")).collect()}
    assert got == {(i, j) for i in sets for j in sets if i < j and jac(set(sets[i]), set(sets[j])) >= 0.86}


def test_components(spark):
    r = random.Random(5)
    links = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    label = {}
    for a, b in links:
        if a != b:
            x, y = label.get(a, {a}), label.get(b, {b})
            for n in (both := x | y):
                label[n] = both
    got = {x.node: x.component for x in R.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: min(s) for n, s in label.items()}


def plain_candidate(i, **other):
    title = "neural graph learning"
    own = {"component": 0, "idx": i, "title": title, "norm_title": title, "class": 0, "raw": title.split(), "norm": title.split(), "ids": {"doi": str(i)}, "aliases": [f"doi:{i}", f"title:{title}"], "year": 2000, "authors": [], "author_keys": ["lee"]}
    return own | {"venue": None, "venue_tokens": [], "venue_family": None, "venue_packs": [], "provider": None, "citations": None, "near": []} | other


def test_groups_that_conflict_are_not_looked_at(monkeypatch):
    seen, real = [], R.evidence
    monkeypatch.setattr(R, "evidence", lambda g, c: seen.append(1) or real(g, c))
    groups = []
    R.settle([plain_candidate(i) for i in range(300)], groups)
    assert len(groups) == 300 and len(seen) <= 300


def test_a_round_gets_no_group_that_its_candidates_cannot_join(spark):
    groups = [R.opened(plain_candidate(i)) for i in range(50)]
    state = spark.createDataFrame([tuple(g[n] for n in R._STATE_NAMES) for g in groups], R.STATE)
    schema = "component long, idx long, norm_title string, class long, ids map<string,string>, aliases array<string>, year int, near array<long>"
    asked = lambda *rows: {x.grp for x in R.reached(spark.createDataFrame([tuple(c[n.strip().split(" ")[0]] for n in ("component", "idx", "norm_title", "class", "ids", "aliases", "year", "near")) for c in rows], schema), state).collect()}
    assert asked(plain_candidate(60)) == set()
    assert asked(plain_candidate(61, ids={"doi": "7"}, aliases=["doi:7", "title:neural graph learning"])) == {7}
    other = {"ids": {"pmid": "1"}, "aliases": ["pmid:1", "title:neural graph learning"]}
    assert asked(plain_candidate(62, **other), plain_candidate(63, **other)) == {0, 1}
    assert asked(plain_candidate(64, ids={}, aliases=["title:neural graph learning"])) == {0}
