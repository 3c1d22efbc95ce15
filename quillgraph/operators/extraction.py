"""Typed records from the sections of papers: problems, methods, data sets, benchmarks, metrics, claims, findings, limitations, assumptions, goals, future work, evidence.

The rules are a table. Every rule names the literals of which a sentence must have one; all literals of all rules are one automaton, so a section is
scanned once, and only the rules whose literals stand in a sentence try their pattern on it. A rule holds in the sections of its roles, with the
confidence that the role gives; where several patterns of one rule match, the first counts (methods) or all do (problems). Spans are
code points of the section's text. What links to names found elsewhere in the paper (a finding to a metric, evidence to a data set) is decided after the
scan by a join with the paper's names. Of equal records of a paper and type the surest, longest and first counts, and of each type so many as ``MOST`` says: that is the
definition of the record list, not a bound on what is read; ``most=None`` gives all.

sections(doc, ord, role, heading, text), papers(doc, title). Records inferred from concept n-grams without a sentence are not made here (``concept_ngrams`` finds those).

Cases: null texts and titles are empty; sections without sentences and papers without sections give what their titles give; repeated sections give equal records,
which count once; a paper without abstract takes its first section for it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import text as T
from quillgraph.runtime import cut

#: Records of each type that a paper keeps, and names that say nothing.
MOST = {"problem": 4, "method": 3, "dataset": 6, "benchmark": 6, "claim": 5, "finding": 6, "limitation": 5, "assumption": 5, "goal": 4, "future": 4, "evidence": 8}
GENERIC = (
    "paper study approach method methods framework system model models analysis results result discussion conclusion background abstract introduction problem problems task tasks research evaluation experiment experiments"
    " dataset datasets metric metrics benchmark benchmarks workflow performance finding findings"
).split() + ["future work", "future direction"]
#: Metrics by name, and whether more is better.
METRICS = {
    "Accuracy": (r"accuracy", True), "Precision": (r"precision", True), "Recall": (r"recall", True), "F1 Score": (r"f1(?:[-\s]?score)?", True), "AUC": (r"(?:roc[-\s]?auc|auc)", True), "BLEU": (r"bleu", True), "ROUGE": (r"rouge", True),
    "Perplexity": (r"perplexity", False), "Loss": (r"loss", False), "MAE": (r"mae", False), "RMSE": (r"rmse", False), "MRR": (r"mrr", True), "NDCG": (r"ndcg", True), "Latency": (r"latency", False), "Throughput": (r"throughput", True),
}
#: What a sentence of each type says, as alternatives.
CLAIM = "show demonstrate find improve outperform enable reveal indicate suggest achieve support reduce increase expose trace".split()
ASSUMPTION = ["assume", "assumption", "given access to", "under the setting", "requires?", "relies on", "depends on", "available knowledge", "high[- ]quality labels?"]
FUTURE = ["future work", "future research", "we plan to", "could be extended", "can be extended", "explore", "investigate", "extend to", "remains to"]
EVIDENCE = "result results benchmark baseline ablation outperform improve improved gain gains degrade drop score accuracy f1 bleu auc latency throughput".split()
FINDING = ["we find", "we found", "our findings", "finding", "observ(?:e|ed)", "reveal", "shows? that", "results show", "analysis shows"]
GOAL = ["our goal", "aim to", "goal is to", "objective", "we aim", "this paper aims", "our mission", "we seek to", "we strive to", "our purpose", "intends to", "designed to"]
LIMITATION = [
    r"cannot", r"can\s+not", r"unable\s+to", r"fails?\s+to", r"failure\s+(?:on|under|when|to)", r"suffers?\s+from", r"struggles?\s+(?:with|on|to)", r"limited\s+(?:to|by)", r"sensitive\s+to", r"lack(?:s|ing)?\s+",
    r"does\s+not\s+(?:generaliz|improv|handle|support|scale|account|address)", r"do\s+not\s+(?:generaliz|handle|support|address)", r"not\s+(?:evaluated|tested|validated)", r"remains?\s+(?:unclear|unexplored|challenging)", r"may\s+(?:fail|be\s+violated)",
    r"requires?\s+(?:access|manual|labelled|labeled)", r"computationally\s+(?:expensive|costly)", r"performance\s+(?:degrades?|drops?)", r"accuracy\s+(?:decreases?|drops?)", r"restricted\s+to", r"depends?\s+on", r"reli(?:es|ant)\s+on",
    r"only\s+(?:works?|supports?|applies)\s+(?:for|on|with|to)",
]
FAILURE = r"\b(?:drop|decline|decrease|degradation)\s+in\b[^.!?]{0,65}\b(?:accuracy|performance|recall|precision)|\b(?:accuracy|performance)\b[^.!?]{0,40}\b(?:declines?|degrades?|drops?)\b"
STATED = r"\b(?:limitation|drawback|shortcoming)s?\b[^.!?]{5,}\b(?:is|are|include|concern|due|because|when|that|of)\b"
PROBLEM_SPANS = [
    (r"\b(?:we|this paper|this work)\s+(?:study|address(?:es)?|tackle(?:s|d)?|focus(?:es)? on|investigate(?:s|d)?)\s+(.+?)(?:\.|,|;| while | by | with )", ("study", "address", "tackle", "focus", "investigate")),
    (r"\b(?:challenge|problem|task)\s+(?:of|in)\s+(.+?)(?:\.|,|;)", ("challenge", "problem", "task")), (r"\bexisting methods?\s+(?:fail|struggle)\s+to\s+(.+?)(?:\.|,|;)", ("existing method",)),
]
METHOD_SPANS = [
    (r"\b(?:we|this paper|this work)\s+(?:propose|present|introduce|develop)\s+(.+?)(?:\.|,|;| that | which )", ("propose", "present", "introduce", "develop")),
    (r"\bour\s+(?:approach|method|framework|system)\s+(?:builds|uses|combines|relies on|consists of|links)\s+(.+?)(?:\.|,|;| to | for )", ("our",)), (r"\bthe key idea is\s+(.+?)(?:\.|,|;)", ("key idea",)),
]
NAMED = r"[A-Z][A-Za-z0-9-]+(?:[- ][A-Z0-9][A-Za-z0-9-]+)"
DATASET = rf"\b({NAMED}{{0,4}}\s+(?:dataset|corpus|benchmark|benchmarks))\b"
BENCHMARK = [rf"\b({NAMED}{{0,5}}\s+benchmark)\b", r"\bbenchmark(?:s)?\s+(?:such as|including)\s+([A-Z][A-Za-z0-9-]+(?:,\s*[A-Z][A-Za-z0-9-]+)*)\b"]
#: Kinds within a type, the first that matches counts.
KINDS = {
    "claim": [("performance", "outperform|improve|gain|achieve"), ("capability", "enable|support|allows?|helps?"), ("boundary", "degrade|degraded|worse|fail|fails|drop|limited|sensitive|cannot|unable"), ("finding", "")],
    "finding": [("ablation", "ablation|component|module"), ("comparison", "compare|baseline|outperform|gain|improve"), ("failure-mode", "fail|failure|degrade|drop|sensitive"), ("finding", "")],
    "limitation": [("supervision", "label|annotation|supervised|manual"), ("efficiency", "cost|expensive|latency|memory|compute|throughput"), ("robustness", "noise|robust|sensitive|corruption"), ("generalization", "domain|generaliz|cross-domain|transfer"), ("evaluation", "evidence|benchmark|evaluate|compare|baseline"), ("limitation", "")],
    "assumption": [("supervision", "label|annotation|supervised"), ("external-access", "access|retrieval|external knowledge|knowledge base"), ("distribution", "distribution|domain|iid|in-domain"), ("structure", "graph|structure|schema"), ("assumption", "")],
}
_RESULTS = ("abstract", "results", "analysis", "discussion", "conclusion")


@dataclass(frozen=True)
class Rule:
    """Sentences of these roles are records of the type if the pattern matches; ``confidence`` by role, None stands for the others."""

    type: str
    pattern: str
    literals: tuple[str, ...]
    roles: tuple[str, ...]
    confidence: dict


def literal(alternative: str) -> str:
    """The text that every match of an alternative begins with, in lower case."""
    plain = re.match(r"[A-Za-z0-9 -]*", alternative)[0]
    rest = alternative[len(plain) :]
    return (plain[:-1] if rest.startswith("?") else plain).lower().rstrip()


def _words(kind: str, alternatives: list[str], roles: tuple, confidence: dict) -> Rule:
    return Rule(kind, r"\b(" + "|".join(alternatives) + r")\b", tuple(dict.fromkeys(map(literal, alternatives))), roles, confidence)


RULES = [
    _words("claim", CLAIM, _RESULTS, {None: 0.82}),
    _words("finding", FINDING, _RESULTS, {"results": 0.84, "analysis": 0.84, None: 0.7}),
    Rule("limitation", r"\b(?:" + "|".join(LIMITATION) + r")\b|" + FAILURE + "|" + STATED, (*dict.fromkeys(map(literal, LIMITATION)), "drop", "decline", "decrease", "degrad", "limitation", "drawback", "shortcoming"), ("discussion", "analysis", "conclusion", "results", "method"), {"discussion": 0.8, "conclusion": 0.8, None: 0.66}),
    _words("assumption", ASSUMPTION, ("method", "preliminaries", "experiments", "body", "introduction"), {None: 0.68}),
    _words("future", FUTURE, ("discussion", "conclusion"), {None: 0.82}),
    _words("goal", GOAL, ("introduction", "abstract", "conclusion"), {"introduction": 0.85, None: 0.72}),
    _words("evidence", EVIDENCE, ("results", "analysis", "discussion", "abstract"), {"results": 0.86, "analysis": 0.86, None: 0.7}),
]
_DIGIT, _DATA, _NAMES = re.compile(r"\d"), re.compile(r"(?i)dataset|corpus|benchmark"), re.compile("dataset|corpus|benchmark")
_FINDS, _SHOWS = (next(r.roles for r in RULES if r.type == kind) for kind in ("finding", "evidence"))
_SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?]+|$)?")
_SURE = re.compile(r"\bassume|assumption|given access to|under the setting\b", re.I)
_RECORDS = "doc string, ord long, role string, type string, kind string, name string, text string, start int, stop int, confidence double, metrics array<string>, sure boolean"


def _span(text: str) -> str:
    """The name within a matched span."""
    for pattern, to in ((r"^(?:present|propose|introduce|develop|build|built|use|uses|using)\s+", ""), (r"\b(?:using|with|through|via|by)\b.*$", ""), (r"\b(?:that|which)\b.*$", ""), (r"^(?:the problem of|the task of|a|an|the)\s+", "")):
        text = re.sub(pattern, to, text, count=1, flags=re.I | re.S)
    text = re.sub(r"^(?:a|an|the)\s+", "", re.sub(r"^[^A-Za-z0-9一-鿿]+", "", re.sub(r"\s+", " ", text)), count=1, flags=re.I)
    return text.strip()[:140]


def _kind(kinds: list, text: str) -> str:
    return next(name for name, words in kinds if re.search(rf"\b({words})\b" if words else "", text, re.I))


class Scanner:
    """All rules as one automaton of literals and one compiled pattern each."""

    def __init__(self) -> None:
        import ahocorasick

        self.rules = [(r, re.compile(r.pattern, re.I)) for r in RULES]
        self.problems, self.methods = ([(re.compile(p, re.I | re.S), literals) for p, literals in spans] for spans in (PROBLEM_SPANS, METHOD_SPANS))
        self.metrics = [(label, re.compile(rf"\b{p}\b", re.I)) for label, (p, _) in METRICS.items()]
        self.names = [("dataset", re.compile(DATASET), 0.8), *(("benchmark", re.compile(p), 0.78) for p in BENCHMARK)]
        bits: dict[str, int] = {}
        groups = [r.literals for r in RULES] + [ls for _, ls in (*PROBLEM_SPANS, *METHOD_SPANS)] + [tuple(re.findall(r"[a-z0-9]{2,}", p)[-1:] if label == "AUC" else (re.match(r"[a-z0-9]+", p)[0],)) for label, (p, _) in METRICS.items()]
        for i, literals in enumerate(groups):
            for word in literals:
                bits[word] = bits.get(word, 0) | 1 << i
        self.automaton = ahocorasick.Automaton()
        for word, mask in bits.items():
            self.automaton.add_word(word, (len(word), mask))
        self.automaton.make_automaton()
        self.tried = 0

    def sentences(self, text: str) -> Iterator[tuple[int, int, int]]:
        """Start, end and mask of the rules that may fire, of each sentence."""
        low = text.lower()
        hits = list(self.automaton.iter(low)) if len(low) == len(text) else None  # lower-casing moved offsets: every rule is tried
        at = 0
        for m in _SENTENCE.finditer(text):
            mask = 0 if hits is not None else -1
            while hits is not None and at < len(hits) and hits[at][0] < m.end():
                end, (n, bits) = hits[at]
                if end - n + 1 >= m.start():
                    mask |= bits
                at += 1
            start, stop = m.start() + len(m[0]) - len(m[0].lstrip()), m.end() - len(m[0]) + len(m[0].rstrip())
            if start < stop:
                yield start, stop, mask

    def scan(self, role: str, abstract: bool, problems: bool, methods: bool, heading: str, text: str) -> Iterator[tuple]:
        """type, kind, name, text, start, stop, confidence, metrics, sure of the records of a section."""
        n_rules, n_problems = len(self.rules), len(self.problems)
        # without a literal only a number (findings) or a named collection (evidence) makes a record, so most sections are looked at once for these
        digits = role in _FINDS and _DIGIT.search(text)
        data = role in _SHOWS and _DATA.search(text)
        for start, stop, mask in self.sentences(text):
            if not mask and not (digits and _DIGIT.search(text, start, stop)) and not (data and _DATA.search(text, start, stop)):
                continue
            said = re.sub(r"\s+", " ", text[start:stop])
            labels = []
            for i, (label, pattern) in enumerate(self.metrics):
                if mask >> n_rules + n_problems + len(self.methods) + i & 1:
                    self.tried += 1
                    if m := pattern.search(text, start, stop):
                        labels.append(label)
                        yield "metric", None, label, label, m.start(), m.end(), 0.88, None, True
            for i, (rule, pattern) in enumerate(self.rules):
                linked = rule.type in ("finding", "evidence") and (labels or rule.type == "evidence" and re.search(r"(?i)dataset|corpus|benchmark", said))
                digit = rule.type == "finding" and re.search(r"\d", said)
                if role not in rule.roles or not (mask >> i & 1 or linked or digit):
                    continue
                self.tried += 1
                fits = bool(pattern.search(said))
                if fits or linked or digit:
                    sure = 0.84 if rule.type == "assumption" and _SURE.search(said) else rule.confidence.get(role, rule.confidence[None])
                    yield rule.type, _kind(KINDS[rule.type], said) if rule.type in KINDS else None, said, said, start, stop, sure, labels, bool(fits or labels or digit)
            for group, wanted, kind, first in ((self.problems, abstract or problems, "problem", n_rules), (self.methods, abstract or methods, "method", n_rules + n_problems)):
                for i, (pattern, _) in enumerate(group):
                    if wanted and mask >> first + i & 1:
                        self.tried += 1
                        if m := pattern.search(said):
                            yield kind, None, _span(m[1]), said, start, stop, 0.78, None, True
                            if kind == "method":
                                break
        shift = len(heading) + 1
        whole = f"{heading}\n{text}"
        for kind, pattern, sure in self.names if _NAMES.search(whole) else ():
            for m in pattern.finditer(whole):
                parts = m[1].split(",") if kind == "benchmark" else [m[1]]
                for part in parts:
                    name = re.sub(r"\s+", " ", part).strip()
                    if kind == "dataset" or len(m[1]) >= 5:
                        yield kind, None, name, name, m.start(1) - shift, m.end(1) - shift, sure, None, True


def title_hints(title: str) -> Iterator[tuple[str, str]]:
    """What a title says about its method and problem."""
    title = re.sub(r"\s+", " ", title).strip()
    parts = [p.strip() for p in title.split(":") if p.strip()]
    if len(parts) > 1:
        yield "method", parts[0]
        yield "problem", ": ".join(parts[1:])
    for pattern in (r"^(.+?)\s+for\s+(.+)$", r"^(.+?)\s+towards?\s+(.+)$"):
        if m := re.match(pattern, title, re.I):
            yield "method", m[1]
            yield "problem", m[2]
    if m := re.match(r"^(.+?)\s+with\s+(.+)$", title, re.I):
        yield "method", m[1]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner, names = Scanner(), [x.strip().split(" ")[0] for x in _RECORDS.split(",")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    types = [kinds[x.strip().split(" ")[1]] for x in _RECORDS.split(",")]
    for batch in batches:
        rows = []
        for doc, ord_, role, heading, text, abstract, problems, methods in zip(*(batch.column(c).to_pylist() for c in ("doc", "ord", "role", "heading", "text", "is_abstract", "is_problem", "is_method"))):
            if role == "title":
                rows += [(doc, ord_, role, kind, None, hint, text, 0, len(text), 0.95 if kind == "problem" else 0.94, None, True) for kind, hint in title_hints(text)]
            rows += [(doc, ord_, role, *r) for r in scanner.scan(role, abstract, problems, methods, heading, text)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), types)], names)


def records(papers: DataFrame, sections: DataFrame, most: dict[str, int] | None = MOST) -> DataFrame:
    """doc, type, kind, name, text, ord, role, start, stop, confidence, metrics, place of the records of each paper; ord -1 is the title."""
    s = sections.select(F.col("doc").cast("string").alias("doc"), F.col("ord").cast("long").alias("ord"), F.coalesce("role", F.lit("body")).alias("role"), F.coalesce("heading", F.lit("")).alias("heading"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["doc", "ord", "role", "heading", "text"])
    by_doc = Window.partitionBy("doc").orderBy(F.when(F.col("role") == "abstract", 0).otherwise(1), "ord", "text")
    by_group = Window.partitionBy("doc", "_g").orderBy("ord", "text")
    group = F.when(F.col("role") == "introduction", "i").when(F.col("role").isin("method", "preliminaries", "body"), "m").otherwise("")
    s = s.withColumn("is_abstract", F.row_number().over(by_doc) == 1).withColumn("_g", group).withColumn("_n", F.row_number().over(by_group))
    s = s.withColumn("is_problem", (F.col("_g") == "i") & (F.col("_n") == 1)).withColumn("is_method", (F.col("_g") == "m") & (F.col("_n") <= 3)).drop("_g", "_n")
    no = F.lit(False)
    titles = papers.select(F.col("doc").cast("string").alias("doc"), F.lit(-1).cast("long").alias("ord"), F.lit("title").alias("role"), F.lit("").alias("heading"), F.coalesce("title", F.lit("")).alias("text"), no.alias("is_abstract"), no.alias("is_problem"), no.alias("is_method")).dropDuplicates(["doc"])
    found = titles.unionByName(s).mapInArrow(_scan, _RECORDS).withColumn("norm", T.normalize(F.col("name"))).where((F.length("norm") >= 4) | (F.col("type") == "metric")).where(~F.col("norm").isin(GENERIC))
    found = cut(found, "typed-records")  # it is read three times, and each would scan all sections
    # sentences that name a data set of the paper count as evidence too
    doubt = found.where("not sure").withColumn("_n", F.monotonically_increasing_id())
    data = found.where("type = 'dataset'").select("doc", F.col("norm").alias("data")).distinct()
    named = doubt.join(data, "doc").where(F.contains("norm", "data")).drop("data", "_n").distinct()
    rows = found.where("sure").unionByName(named)
    early = F.when(F.col("type").isin("dataset", "benchmark", "metric"), F.col("ord")).otherwise(F.lit(0))
    order = [F.desc("confidence"), early, F.when(early != 0, F.col("start")).otherwise(F.lit(0)), F.desc(F.when(early == 0, F.length("name")).otherwise(F.lit(0))), F.asc("ord"), F.asc("start"), F.asc("name")]
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("doc", "type", "norm").orderBy(*order))).where("_r = 1")
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("doc", "type").orderBy(*order)))
    if most is not None:
        limit = F.coalesce(*[F.when(F.col("type") == t, F.lit(n)) for t, n in most.items()], F.lit(len(METRICS)))
        placed = placed.where(F.col("place") <= limit)
    return placed.select("doc", "type", "kind", "name", "text", "ord", "role", "start", "stop", "confidence", "metrics", "place")
