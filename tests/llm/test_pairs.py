"""Near-duplicates and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tests.llm import cases
from ventide.llm import components, forest, queries, rotation, suffix
from ventide.llm.tables import ready

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str | None) -> frozenset:
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = WORD.findall(lowered)
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def reach(ids, links):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def alike(rows):
    """Key -> (set size, component) by comparing all pairs."""
    sets = [(k, shingles(t)) for k, t in rows if k is not None]
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2)
             if a != b and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    label = reach([k for k, _ in sets], links)
    return sorted((k, len(s), label[k]) for k, s in sets)


def mutated(seed: int):
    """Families of near copies at all distances, and loners."""
    rng = random.Random(seed)
    rows, key = [], 0
    for family in range(12):
        words = cases.prose(seed * 100 + family, rng.choice([7, 30, 90, 200])).split()
        for _ in range(rng.randrange(1, 9)):
            copy = list(words)
            for _ in range(rng.randrange(0, max(2, len(words) // 18))):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(1000)}"
            rows.append((key, " ".join(copy), "en", "s", 1))
            key += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_finds_what_all_pairs_find(spark, seed):
    rows = mutated(seed)
    got = forest.classify(cases.frame(ready(spark), rows)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == alike([r[:2] for r in rows])
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_forest_takes_awkward_rows(spark):
    rows = cases.awkward()
    got = forest.classify(cases.frame(ready(spark), rows, clash=True)).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) \
        == alike([r[:2] for r in rows])
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)


def test_forest_links_every_text_of_a_key(spark):
    a, b = cases.prose(31, 120).split(), cases.prose(32, 120).split()
    rows = [(13, " ".join(a), "en", "s", 1), (13, " ".join(b), "en", "s", 1), (20, " ".join(a[:60] + ["x"] + a[61:]), "en", "s", 1),
            (21, " ".join(b[:60] + ["y"] + b[61:]), "en", "s", 1), (22, cases.prose(33, 90), "en", "s", 1)]
    got = forest.classify(cases.frame(ready(spark), rows)).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [
        (13, 13, True), (13, 13, True), (20, 13, False), (21, 13, False), (22, 22, True)]


def test_closest_neighbours_are_one_a_class(spark):
    """By the longest common prefix over all trees, before anything is joined."""
    rng, words, rows = random.Random(9), cases.prose(78, 150).split(), []
    for i in range(300):
        copy = list(words)
        copy[rng.randrange(150)] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(copy), "en", "s", 1))
    signed = forest._signed(cases.frame(ready(spark), rows).select("doc_id", "text"), "doc_id", "text", ()).collect()
    paths = {r["_id"]: np.frombuffer(r["_signature"], np.uint16).reshape(forest.TREES, forest.DEPTH) for r in signed}
    classes = spark.createDataFrame([(r["_id"], bytes(r["_signature"]), r["_id"]) for r in signed], "id long, signature binary, label long")
    pairs = {(r["a"], r["b"]): r["prefix"] for r in forest.candidates(classes, 1).collect()}
    for (a, b), prefix in pairs.items():
        shared = np.logical_and.accumulate(paths[a] == paths[b], axis=1).sum(1)
        assert forest.LEAST <= prefix <= shared.max()
    best = {r["b"]: r["a"] for r in forest.closest(forest.candidates(classes, 1)).collect()}
    assert len(best) > 280 and all(pairs[a, b] == max(p for (_, y), p in pairs.items() if y == b) for b, a in best.items())


def test_forest_of_nothing(spark):
    assert forest.classify(cases.frame(ready(spark), [])).collect() == []


def test_forest_joins_a_large_group_through_neighbours(spark):
    """More members than neighbours: still one component, and no enumeration of pairs."""
    rng, words, rows = random.Random(5), cases.prose(77, 150).split(), []
    for i in range(400):
        copy = list(words)
        for _ in range(2):
            copy[rng.randrange(150)] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(copy), "en", "s", 1))
    got = forest.classify(cases.frame(ready(spark), rows)).collect()
    assert {r["component_id"] for r in got} == {r[2] for r in alike([r[:2] for r in rows])} == {0}


@pytest.mark.parametrize("block", [1024, 100])
def test_forest_finds_the_centre_of_a_crowded_star(spark, monkeypatch, block):
    """Thousands of copies that link with their original and not with each other."""
    monkeypatch.setattr(forest, "BLOCK", block)
    rng, words = random.Random(6), [f"s{i}" for i in range(150)]
    rows = [(5000, " ".join(words), "en", "s", 1)]
    for i in range(2000):
        copy = list(words)
        for n, at in enumerate(rng.sample(range(4, 146), 4)):
            copy[at] = f"x{i}_{n}"
        rows.append((i, " ".join(copy), "en", "s", 1))
    sets = [shingles(r[1]) for r in rows]
    linked = [100 * len(sets[0] & s) >= 75 * len(sets[0] | s) for s in sets[1:]]
    assert sum(linked) == 2000
    got = forest.classify(cases.frame(ready(spark), rows)).collect()
    assert {r["component_id"] for r in got} == {0}


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 101), (7, None)]
    random.Random(1).shuffle(links)
    got = dict(components.components(ready(spark).createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- embeddings -----------------------------------------------------------------------------------

def close(rows, threshold=0.95):
    good = [(k, np.array(v, float)) for k, v in rows
            if k is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    n = [0] * len(good)
    links = []
    for (i, (a, x)), (j, (b, y)) in itertools.combinations(enumerate(good), 2):
        if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
            n[i] += 1
            n[j] += 1
            links.append((a, b))
    label = reach([k for k, _ in rows if k is not None], links)
    out = [(k, c, label[k]) for (k, _), c in zip(good, n)]
    seen = {k for k, _ in good}
    return sorted(out + [(k, 0, k) for k, _ in rows if k is not None and k not in seen])


def vectors(seed: int, width: int = 24):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(25):
        centre = rng.standard_normal(width)
        for _ in range(int(rng.integers(1, 8))):
            rows.append((len(rows), (centre + rng.standard_normal(width) * 0.28 * rng.random()).tolist()))
    return rows


SHAPE = "vec_id long, embedding array<double>"


def test_codes_find_what_all_pairs_find(spark):
    rows = vectors(3)
    got = rotation.classify(ready(spark).createDataFrame(rows, SHAPE)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == close(rows)


def test_codes_take_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]),
            (6, [nan, 1.0, 0.0]), (7, [inf, 0.0, 0.0]), (8, [None, 1.0, 0.0]), (9, [1.0, 0.0]), (10, [-1.0, 0.0, 0.0])]
    df = ready(spark).createDataFrame(rows + [(None, [1.0, 0.0, 0.0])], SHAPE).selectExpr("*", "'x' AS weight", "'y' AS keys")
    got = rotation.classify(df).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None) == close(rows)
    assert [tuple(r) for r in got if r["vec_id"] is None] == [(None, 0, None, True)]
    twice = rotation.classify(spark.createDataFrame([(1, [1.0, 1.0]), (1, [1.0, 1.0])], SHAPE)).collect()
    assert [tuple(r) for r in twice] == [(1, 1, 1, True)] * 2
    assert rotation.classify(spark.createDataFrame([], SHAPE)).collect() == []


def test_crowded_buckets_are_split_and_counted_once(spark, monkeypatch):
    monkeypatch.setattr(rotation, "BLOCK", 8)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + rng.standard_normal(16) * 0.05).tolist()) for i in range(60)]
    got = rotation.classify(ready(spark).createDataFrame(rows, SHAPE)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == close(rows)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(6)
    x, y = rng.standard_normal((2, 4000, 64))
    y = 0.7 * x + 0.7 * y
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    signs, _, factor = rotation.codes(x)
    turned = y @ rotation.rotation(64, 0)
    estimate = (signs * turned).sum(axis=1) / (8 * factor)
    truth = (x * y).sum(axis=1)
    error = rotation.DOUBT * np.sqrt(1 - factor**2) / factor / np.sqrt(63)
    assert abs((estimate - truth).mean()) < 0.005
    assert (np.abs(estimate - truth) <= error).mean() > 0.999


# --- suffix arrays --------------------------------------------------------------------------------

def removed(rows):
    """(key, text) -> bytes kept, by a set of all strings seen so far."""
    length, seen, out = suffix.LENGTH, set(), []
    for key, text in rows:
        raw = (text or "").encode()
        covered, new = bytearray(len(raw)), set()
        for p in range(len(raw) - length + 1):
            s = raw[p:p + length]
            if s in seen or s in new:
                covered[p:p + length] = b"\1" * length
            new.add(s)
        seen |= new
        runs = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out.append((key, len(raw), sum(covered), runs,
                    hashlib.sha256(bytes(b for b, c in zip(raw, covered) if not c)).hexdigest()))
    return out


def passages(seed: int):
    rng = random.Random(seed)
    pool = [cases.prose(seed * 50 + i, rng.choice([14, 25, 70]), 60) for i in range(6)]
    rows = []
    for i in range(70):
        parts = [rng.choice(pool) if rng.random() < 0.5 else cases.prose(i * 7 + j + seed, 20, 60) for j in range(rng.randrange(1, 5))]
        rows.append((i, "é" * rng.randrange(3) + " ".join(parts) + rng.choice(["", "\n" * 130, "ab" * 90]), "en", "s", 1))
    return rows


@pytest.mark.parametrize("bucket", [1000, 2])
def test_suffix_arrays_remove_what_a_set_of_strings_removes(spark, tmp_path, monkeypatch, bucket):
    monkeypatch.setattr(suffix, "BUCKET", bucket)  # 2: most anchors are too hot for one array
    rows = passages(3)
    folder = cases.write(ready(spark), tmp_path, rows)
    got = queries.QUERIES["op1_suffix_array"](spark, folder).collect()
    assert sorted(tuple(r) for r in got) == removed(sorted(r[:2] for r in rows))


def test_suffix_arrays_take_awkward_rows(spark):
    rows = cases.awkward()
    got = suffix.cut(cases.frame(ready(spark), rows, clash=True))
    assert [c for c in got.columns if c in cases.CLASH and c not in ("removed", "n_bytes", "kept_bytes")] \
        == [c for c in cases.CLASH if c not in ("removed", "n_bytes", "kept_bytes")]
    found = sorted((r["doc_id"], r["n_bytes"], sum(x["high"] - x["low"] for x in r["removed"])) for r in got.collect()
                   if r["doc_id"] is not None)
    unique = [r[:2] for r in rows if r[0] not in (None, 13)]
    single = sorted(set(unique), key=lambda r: r[0])
    assert {f for f in found if f[0] != 13} == {x[:3] for x in removed(single)}
    assert [f for f in found if f[0] == 9] == [f for f in found if f[0] == 9][:1] * 2
    assert sorted(f[1:] for f in found if f[0] == 13) == [(350, 349), (500, 499)]  # overlaps count
    assert suffix.cut(cases.frame(spark, [])).collect() == []


def test_whole_characters_stay_valid():
    raw = np.frombuffer("aéb中c".encode(), np.uint8)
    assert suffix.characters(raw, 2, 5) == (3, 4)
    assert suffix.characters(raw, 1, 3) == (1, 3)


def test_previous_factors_against_their_definition():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 300).astype(np.uint8)
    length = 12
    starts = np.concatenate([np.arange(0, 139), np.arange(150, 289)])  # each suffix has 12 bytes of its own block
    group = (starts >= 150).astype(np.int64)
    base = np.repeat([0, 1], 150)
    got = suffix.previous_factors(data, base, starts, group, length)
    for i in range(len(starts)):
        best = 0
        for j in range(i):
            if group[i] == group[j]:
                same = data[starts[i]:starts[i] + length] == data[starts[j]:starts[j] + length]
                best = max(best, length if same.all() else int(np.argmin(same)))
        assert got[i] == best
