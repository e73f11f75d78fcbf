"""Stems by the published examples; postings and stemmed ranking against loops."""

from __future__ import annotations

import math
import random
import re

import pytest

from ventide.functions.stem import stem
from ventide.operators import postings, retrieval

# Examples of the published algorithm.
EXAMPLES = """caresses caress  ponies poni  ties ti  cats cat  feed feed  agreed agre  plastered plaster  bled bled  motoring motor
sing sing  conflated conflat  troubled troubl  sized size  hopping hop  tanned tan  falling fall  hissing hiss  fizzed fizz
failing fail  filing file  happy happi  sky sky  relational relat  conditional condit  rational ration  digitizer digit
vietnamization vietnam  predication predic  operator oper  feudalism feudal  decisiveness decis  hopefulness hope
callousness callous  formaliti formal  sensitiviti sensit  sensibiliti sensibl  triplicate triplic  formative form
formalize formal  electriciti electr  electrical electr  hopeful hope  goodness good  revival reviv  allowance allow
inference infer  airliner airlin  adjustable adjust  irritant irrit  replacement replac  adjustment adjust  dependent depend
adoption adopt  communism commun  activate activ  angulariti angular  homologous homolog  effective effect
bowdlerize bowdler  probate probat  rate rate  cease ceas  controll control  roll roll"""


def test_stems():
    words = EXAMPLES.split()
    assert {w: stem(w) for w in words[::2]} == dict(zip(words[::2], words[1::2], strict=True))
    assert [stem(w) for w in ("", "as", "h2o", "2024", "spo2", "naïve")] == ["", "as", "h2o", "2024", "spo2", "naïve"]


WORDS = "ventilate ventilator ventilation pressure pressures adjust adjusted adjustment the of weaning weaned 2 peep lung".split()


def table(seed: int, n: int):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((i, " ".join(rng.choices(WORDS, k=rng.randrange(3))), " ".join(rng.choices(WORDS, k=rng.randrange(60)))))
    return [*rows, (n, None, "pressure adjusted"), (n + 1, "Lung", None), (n + 2, "", ""), (n + 3, "PEEP, peep!", "Peep" * 2)]


CHUNKS = "chunk_id long, title string, text string"
KEYS = [("a", ["ventilator pressure", "PEEP"], "lung"), ("b", ["adjustment"], "weaning of"), ("c", ["2", "absent words here"], ""),
        ("d", [], "")]


def tokens(text: str, stems: bool) -> list[str]:
    return [stem(t) if stems else t for t in re.findall("[a-z0-9]+", text.lower())]


def runs(words: list[str], phrase: str) -> int:
    want = phrase.split(" ")
    return sum(words[i:i + len(want)] == want for i in range(len(words) - len(want) + 1))


def ranked(rows, stems: bool, top: int):
    docs = {i: (tokens(t or "", stems), tokens(x, stems)) for i, t, x in rows if x is not None}
    average = sum(len(t) + len(x) for t, x in docs.values()) / len(docs)
    out = {}
    for key, terms, query in KEYS:
        wanted = {" ".join(tokens(p, stems)) for p in (*terms, *query.split())} - {""}
        counts = {p: {i: f for i, (t, x) in docs.items() if (f := 2 * runs(t, p) + runs(x, p))} for p in wanted}
        scores = {}
        for found in counts.values():
            idf = max(math.log((len(rows) - len(found) + 0.5) / (len(found) + 0.5)), 1e-6) if found else 0
            for i, f in found.items():
                size = sum(map(len, docs[i]))
                scores[i] = scores.get(i, 0) + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / average))
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:top]
        out |= {(key, i): (rank, pytest.approx(s, abs=2e-9)) for rank, (i, s) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize(("stems", "bits"), [(False, 24), (True, 24), (True, 6)])
def test_ranking_against_loops(spark, monkeypatch, stems, bits):
    monkeypatch.setattr(postings, "MOST_BITS", bits)  # 6: nearly every run of words is let through, none is lost
    rows = table(3, 60)
    keys = spark.createDataFrame([(k, t, q) for k, t, q in KEYS], "key string, terms array<string>, query string")
    chunks = spark.createDataFrame(rows, CHUNKS).repartition(5)
    got = retrieval.bm25(chunks, retrieval.phrases(keys), top=30, stems=stems).collect()
    # The idf counts all rows, the average length only those with a text.
    assert {(r["key"], r["chunk_id"]): (r["rank"], r["score"]) for r in got} == ranked(rows, stems, 30)
    assert {r["key"] for r in got} == {"a", "b", "c"}


def test_postings_are_counted_inside_the_row(spark):
    rows = table(5, 80)
    chunks = spark.createDataFrame(rows, CHUNKS).repartition(4)
    wanted = spark.createDataFrame([("ventil pressur", 2), ("peep", 1), ("adjust", 1), ("lung of the", 3)], "phrase string, n int")
    title, body = retrieval.index_tokens(chunks.title), retrieval.index_tokens(chunks.text)
    found = postings.postings(chunks, wanted, [1, 2, 3], "chunk_id", title, body, 2, stems=True)
    got = {(r["chunk_id"], r["phrase"]): (r["_len"], r["f"]) for r in found.collect()}
    want = {}
    for i, t, x in rows:
        if x is not None:
            head, rest = tokens(t or "", True), tokens(x, True)
            for p in ("ventil pressur", "peep", "adjust", "lung of the"):
                if f := 2 * runs(head, p) + runs(rest, p):
                    want[i, p] = (len(head) + len(rest), f)
    assert got == want and len(got) > 50
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()  # no row per run of words
    assert postings.postings(chunks, wanted.limit(0), [], "chunk_id", title, body, 2).collect() == []
    assert postings.postings(chunks.limit(0), wanted, [1], "chunk_id", title, body, 2).collect() == []
