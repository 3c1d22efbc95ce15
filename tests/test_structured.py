"""Citation contexts of TEI and body texts."""

import json
import random
from xml.sax.saxutils import escape

from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.sources import structured as S

TEI = """<?xml version="1.0"?><TEI><teiHeader><p>Not body <ref type="bibr" target="#b0">[0]</ref></p></teiHeader><text><body>
<div type=""><head>1. Introduction</head>
<p xml:id="p1">First   sentence has <hi>marks <ref type="bibr" target="#b0">[1]</ref></hi>. Second &amp; <formula>x&lt;y</formula> cites<ref type="bibr" target="#b1 #b9">[2, 9]</ref>.<lb/>Third [1] again <ref type="figure" target="#f">Fig. 1</ref>. Fourth<!-- <ref type="bibr">no</ref> --> <ref type='bibr'>(Nobody)</ref> ends.</p>
<div><head>Inner results</head><p>Deep <ref type="bibr" target="#b1"><hi rend="bold">[</hi>2]</ref>. <ref type="bibr" target="#b1"/></p></div>
<p>After inner <ref type="bibr" target="#b0">[1]</ref></p></div>
<div><head>References</head><p>x <ref type="bibr" target="#b0">[1]</ref></p></div></body>
<back><listBibl><biblStruct xml:id="b0"><analytic><title level="a" type="main">Title  <hi>One</hi></title><author><persName><surname>Lee</surname></persName></author><author><surname>Kim</surname></author><idno type="DOI">https://doi.org/10.1/x</idno></analytic><monogr><title level="j">Journal</title><imprint><date when="2019-05"/></imprint></monogr></biblStruct>
<biblStruct xml:id="b1"><monogr><title>Book</title><imprint><date>about 2001</date></imprint></monogr><idno type="arXiv">arXiv:2001.1</idno></biblStruct></listBibl></back></text></TEI>"""


def test_tei(spark, tmp_path):
    (tmp_path / "a.xml").write_text(TEI)
    rows = S.tei_contexts(S.read_tei(spark, str(tmp_path))).orderBy("section", "start", "ref_id").collect()
    got = [(r.section, r.heading, r.role, r.raw, r.ref_id, r.status) for r in rows]
    one = (1, "1. Introduction", "introduction")
    assert sorted(got, key=str) == sorted([
        (*one, "[1]", "b0", "reference-resolved"), (*one, "[2, 9]", "b1", "reference-resolved"), (*one, "[2, 9]", "b9", "reference-missing"), (*one, "(Nobody)", None, "reference-unresolved"), (*one, "[1]", "b0", "reference-resolved"),
        (2, "Inner results", "evaluation", "[2]", "b1", "reference-resolved"), (2, "Inner results", "evaluation", "", "b1", "reference-resolved"),
    ], key=str)
    by = {(r.raw, r.ref_id, r.paragraph): r for r in rows}
    text = "First sentence has marks [1]. Second & x<y cites[2, 9]. Third [1] again Fig. 1. Fourth (Nobody) ends."
    first, second, last = by["[1]", "b0", "p1"], by["[2, 9]", "b1", "p1"], by["(Nobody)", None, "p1"]
    assert [text[r.start : r.stop] for r in (first, second, last)] == ["[1]", "[2, 9]", "(Nobody)"]
    assert first.context == "First sentence has marks [1]. Second & x<y cites[2, 9]."
    assert last.context.endswith("Fourth (Nobody) ends.") and "First" not in last.context
    refs = {r.ref_id: r for r in S.tei_references(S.read_tei(spark, str(tmp_path))).collect()}
    assert (refs["b0"].title, refs["b0"].year, refs["b0"].lead_author, refs["b0"].authors, refs["b0"].doi) == ("Title One", 2019, "Lee", ["Lee", "Kim"], "10.1/x")
    assert (refs["b1"].title, refs["b1"].year, refs["b1"].arxiv) == ("Book", 2001, "2001.1")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["text ", "a < b & c", "  \n", "Stop. ", "é漢 ", "<not a tag"]), st.sampled_from(["", "hi", "ref", "nest"])), max_size=12))
def test_places_stay_right_across_markup(parts):
    xml, want = "", []
    for i, (text, kind) in enumerate(parts):
        body = escape(text)
        if kind == "ref":
            body = f'<ref type="bibr" target="#b{i}">[{i}]</ref>'
            want.append(f"[{i}]")
        elif kind == "nest":
            body = f'<hi><i>{body}</i><ref type="bibr" target="#b{i}"><b>({i}</b>)</ref><x/></hi>'
            want.append(f"({i})")
        elif kind == "hi":
            body = f"<hi a='>'>{body}</hi>"
        xml += body
    contexts, _ = S.scan_tei(f"<body><p>{xml}</p></body>")
    plain = S._Text()
    for i, (text, kind) in enumerate(parts):
        plain.add(f"[{i}]" if kind == "ref" else text + (f"({i})" if kind == "nest" else ""))
    assert [c[4] for c in contexts] == want
    assert all(str(plain)[c[6] : c[7]].strip() == c[4] and c[4] in c[8] for c in contexts)


def window(text, start, stop):
    if start is None or stop is None or start < 0 or stop < start or start >= len(text):
        return " ".join(text.split())
    first = max(text.rfind(c, 0, start) for c in ".!?\n") + 1
    stop = min(stop, len(text))
    ends = [i for i in (text.find(c, stop) for c in ".!?\n") if i >= 0]
    return " ".join(text[first : min(ends) + 1 if ends else len(text)].split())


def test_body_texts(spark, tmp_path):
    r, papers, want = random.Random(5), [], []
    for i in range(12):
        text = "".join(r.choice(["One two. ", "three, four ", "Five!\n", "[1] ", "é漢😀 "]) for _ in range(12))
        spans = [{"start": r.choice([None, -1, 0, 5, 30, 500]), "end": r.choice([None, 3, 33, 900]), "text": "[1]", "ref_id": r.choice(["BIBREF0", "BIBREF7", None])} for _ in range(4)]
        papers.append({"paper_id": f"p{i}", "title": "t", "abstract": r.choice(["plain", [{"text": text, "section": "Abstract", "cite_spans": spans[:1]}]]), "body_text": [{"text": " ", "cite_spans": spans}, {"text": text, "section": "Intro", "cite_spans": spans}], "bib_entries": {"BIBREF0": {"title": "T", "year": 2010, "authors": [{"last": "Lee"}]}}})
        for kind, block, own in (("abstract", 0, spans[:1] if isinstance(papers[-1]["abstract"], list) else []), ("body_text", 1, spans)):
            want += [(f"p{i}", kind, block, s["ref_id"], window(text, s["start"], s["end"]), "reference-resolved" if s["ref_id"] == "BIBREF0" else "reference-missing" if s["ref_id"] else "reference-unresolved") for s in own]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, papers)) + "\nnot json\n")
    (tmp_path / "b.json").write_text(json.dumps(papers))
    for name in ("a.jsonl", "b.json"):
        got = {(x.paper, x.kind, x.block, x.ref_id, x.context, x.status) for x in S.read_body_contexts(spark, str(tmp_path / name)).collect()}
        assert got == set(want)
