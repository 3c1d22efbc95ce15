"""Gates over records of differing shapes."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import replay_suite as R

GOOD = {
    "status": "passed", "dataset": {"source": "https://x/masterset", "license_scope": "cc", "policy": {"holdout": "by venue and year"}, "time_slice": {"until": 2020}}, "inputs": [{"role": "other"}, {"role": "raw_dataset", "sha256": "ab"}],
    "config": {"primaryCutoff": 20, "thresholds": {"mustCiteRecallAtKImprovement": 0.1}}, "gates": [{"name": "must-cite recall at k", "status": "passed"}],
    "cases": [{"candidate": {"a": 1}, "baseline": {"b": 1}, "gold": {"must_cite_set": ["p"]}, "timeCutoff": "2019"}, {"candidate": {"a": 1}, "baseline": {"b": [0]}, "gold": {"must_cite_set": ["q"], "claims": []}, "time_cutoff": 2018}],
    "statistical_significance": {"metrics": {"recall_at_20_improvement": {"test": "paired bootstrap", "p_value": "0.01", "n": 12, "delta": 0.2}}},
}


def changed(path, value):
    record = copy.deepcopy(GOOD)
    at = record
    for k in path[:-1]:
        at = at[k]
    if value is None:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return record


ENTRY = {"test": "Wilcoxon signed-rank", "p_value": 0.04, "sampleSize": 2, "effect_size": 1}
WRONG = {
    "suite_status_passed": (["status"], "failed"), "dataset_source_present": (["dataset", "source"], " "), "license_scope_present": (["dataset", "license_scope"], None), "raw_input_hash_present": (["inputs"], [{"role": "raw_dataset"}, {"sha256": "x"}]),
    "not_fixture_or_synthetic": (["dataset", "note"], "a mock set"), "strict_time_cutoffs_present": (["cases", 0, "timeCutoff"], "soon"), "venue_year_holdout_present": (["dataset", "policy"], None), "time_slice_policy_present": (["dataset", "time_slice"], None),
    "target_evidence_family_ready": (["gates", 0, "status"], "failed"), "improvement_thresholds_present": (["config", "primaryCutoff"], 10), "candidate_packets_present": (["cases", 0, "candidate"], {}), "gold_labels_present": (["cases", 1, "gold"], {}), "baseline_packets_present": (["cases", 1, "baseline"], None),
}


@pytest.fixture(scope="module")
def verdicts(spark):
    shapes = {
        "list": {"statistics": {"statistical_tests": [{"metric": "x"}, {"metric": "must-cite recall at k improvement", **ENTRY}]}}, "deep": {"statistical_tests": {"results": {"tests": [{"evidence": {"mustCiteRecallAtKImprovement": ENTRY}}]}}},
        "interval": {"statistical_significance": {"must_cite_recall_at_k_improvement": {"method": "bootstrap confidence interval", "confidence_interval": [0.01, 0.5], "estimate": 2, "pair_count": 9}}},
        "no test": {"statistical_significance": {"must_cite_recall_at_k_improvement": {**ENTRY, "test": "t"}}}, "one case": {"statistical_significance": {"must_cite_recall_at_k_improvement": {**ENTRY, "sampleSize": 1}}},
        "p": {"statistical_significance": {"must_cite_recall_at_k_improvement": {**ENTRY, "p_value": 0.06}}}, "effect": {"statistical_significance": {"must_cite_recall_at_k_improvement": {**ENTRY, "effect_size": "-1"}}}, "none": {},
        "second": {"statistical_significance": {"must_cite_recall_at_k_improvement": [{**ENTRY, "p_value": 0.5}, ENTRY]}},
    }
    base = {k: v for k, v in GOOD.items() if k != "statistical_significance"}
    rows = [("good", json.dumps(GOOD)), ("not json", "{"), ("empty", "{}"), ("null", None)] + [(gate, json.dumps(changed(*x))) for gate, x in WRONG.items()] + [(k, json.dumps({**base, **v})) for k, v in shapes.items()]
    out = {}
    for r in R.gates(spark.createDataFrame(rows, "suite string, value string")).collect():
        out.setdefault(r.suite, {})[r.gate] = (r.status, r.reason)
    return out


def test_a_whole_record_passes_every_gate(verdicts):
    assert {s for s, _ in verdicts["good"].values()} == {"passed"} and len(verdicts["good"]) == 15


@pytest.mark.parametrize("gate", WRONG)
def test_each_gate_finds_its_fault(verdicts, gate):
    bad = {g for g, (s, _) in verdicts[gate].items() if s == "incomplete"}
    assert gate in bad and verdicts[gate][gate][1]
    assert bad - {"target_evidence_family_ready"} <= {gate}


def test_significance_in_any_shape(verdicts):
    of = lambda s: verdicts[s]["statistical_significance_present"]
    assert [of(s)[0] for s in ("list", "deep", "interval", "second")] == ["passed"] * 4
    assert [of(s) for s in ("no test", "one case", "p", "effect", "none")] == [("incomplete", "must_cite_recall_at_k_improvement")] * 5


def test_records_without_anything(verdicts):
    for s in ("not json", "empty", "null"):
        assert verdicts[s]["replay_cases_present"] == ("incomplete", "no cases") and verdicts[s]["suite_status_passed"] == ("incomplete", "status unknown")


def test_plain_names_are_made_only_of_paths_that_can_match(spark):
    # each scalar's path went through all expressions of plain names, for every gate that asks for one
    rows = [(i, p) for i, p in enumerate([["config", "HoldoutPolicy"], ["a", "hold_out"], ["timeSlice"], ["Time-Split", "x"], ["slices"], ["x", "spaTemporal"], ["Statistical Tests", "0"], ["statisticalSignificance"], ["statistical"], ["x"], []])]
    df = spark.createDataFrame(rows, "i int, path array<string>")
    for pattern, parts in (("holdout", ["holdout"]), ("time_slice|time_split|temporal", ["slice", "split", "temporal"]), ("^(statistical_significance|statistical_tests)$", ["statistical"])):
        got = df.select(R._named(pattern, *parts).alias("got"), F.exists("path", lambda k: R.plain(k).rlike(pattern)).alias("want")).collect()  # noqa: B023
        assert all(r.got == r.want for r in got) and any(r.want for r in got)


def test_levels_hold_scalars_as_texts(spark, monkeypatch):
    # every reader of the scalars parsed all values of a level once more
    levels = []
    monkeypatch.setattr(R, "cut", lambda df, name="step", cut=R.cut: levels.append(cut(df, name)) or levels[-1])
    found = R.scalars(spark.createDataFrame([("s", '{"a": [1, {"b": "x"}], "c": null, "d": true}')], "suite string, value string"))
    assert sorted((r.path, r.key, r.text) for r in found.collect()) == [(["a", "0"], "a", "1"), (["a", "1", "b"], "b", "x"), (["d"], "d", "true")]
    assert all({"text", "v"} <= set(x.columns) and x.where("text is not null and v is not null").isEmpty() for x in levels)
