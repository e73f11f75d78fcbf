"""Line bitmaps, spelling variants and periodic runs against their definitions."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from ventide.llm import lines, periods, queries, spelling
from ventide.llm.tables import ready

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ("n_lines", "n_dropped", "keep_bitmap", "kept_text", "doc", "mark", "pos", "row", "own", "own_mark", "h1",
         "runs", "top", "collapsed", "n_words")


def clashing(df):
    return df.select("*", *(F.lit("mine").alias(c) for c in CLASH if c not in df.columns))


# --- lines ----------------------------------------------------------------------------------------

def keyed(line: str) -> str:
    key = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in key)


def kept_lines(rows, least: int, least_chars: int = 1, keep_first: bool = False):
    """rows: (document, text), in the order of documents."""
    holders = collections.defaultdict(set)
    for i, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            holders[keyed(line)].add(i)
    seen, out = set(), []
    for key, text in rows:
        parts, keep = (text or "").split("\n"), []
        for line in parts:
            k = keyed(line)
            if len(k) < least_chars or len(holders[k]) < least or (keep_first and k not in seen):
                keep.append(line)
            seen.add(k)
        out.append((key, len(parts), len(parts) - len(keep), "\n".join(keep)))
    return out


def line_rows(n: int):
    rng = random.Random(4)
    shared = [f" Shared line {i} É" for i in range(12)]
    out = []
    for i in range(n):
        parts = [rng.choice(shared).upper() if rng.random() < 0.5 else f"own {i} {j} \t" for j in range(rng.randrange(1, 9))]
        if i % 3 == 0:
            parts += ["the common line", "", "the common line  "]
        out.append((i, "\n".join(parts)))
    return out + [(n, None), (n + 1, ""), (n + 2, "\n\n"), (n + 3, "\x0b\r\n \t")]


@pytest.mark.parametrize("keep_first", [False, True])
def test_lines_against_sets(spark, keep_first):
    ready(spark)
    rows = line_rows(150)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for parts in ("40", "2"):  # many ranges: keys that go on over borders
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        try:
            got = lines.dedup(docs, least=6, keep_first=keep_first).orderBy("doc_id").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
            ready(spark)
        assert [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got] == kept_lines(rows, 6, 1, keep_first)
    maps = {r["doc_id"]: (r["keep_bitmap"], r["n_lines"], r["n_dropped"]) for r in got}
    for bitmap, n, dropped in maps.values():
        assert (~lines.kept_lines(bitmap, n)).sum() == dropped and (bitmap is None) == (dropped == 0)


def test_shortest_key_counts_code_points(spark):
    rows = [(i, "éa\néab\nlong enough") for i in range(4)]
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), least=3, least_chars=3).collect()
    assert {r["kept_text"] for r in got} == {"éa"}


def test_awkward_lines(spark):
    ready(spark)
    rows = cases.awkward() + [(50 + i, "a heading\nbody", "en", "a", 1) for i in range(3)] + [(60, "a heading\nx", "en", "a", 1)] * 9
    got = lines.dedup(clashing(cases.frame(spark, rows, clash=True)), least=10).collect()
    want = kept_lines([r[:2] for r in rows], 10)
    shown = lambda rows: sorted((str(a), b, c, d) for a, b, c, d in rows)
    assert shown((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got) == shown(want)
    assert {r["size"] for r in got} == {"mine size"} and {r["row"] for r in got} == {"mine"}
    assert lines.dedup(cases.frame(spark, [])).collect() == []


# --- words ----------------------------------------------------------------------------------------

def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


def grouped(count: dict[str, int], ratio: int = 2):
    near = {w: [v for v in count if one_edit(w, v)] for w in count}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-count[v], v.encode()), default=None)
        form[w] = best if best is not None and count[best] >= ratio * count[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), n, len(near[w]), count[form[w]] if form[w] else None) for w, n in count.items()}


def invented(n: int, letters: str, seed: int) -> dict[str, int]:
    rng, out = random.Random(seed), {}
    while len(out) < n:
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(5, 11)))
        out[word] = rng.randrange(3, 200)
        for _ in range(rng.randrange(4)):
            at, c = rng.randrange(len(word)), rng.choice(letters)
            word = rng.choice([word[:at] + word[at + 1:], word[:at] + c + word[at:], word[:at] + c + word[at + 1:]])
            if len(word) >= 5:
                out[word] = rng.randrange(3, 200)
    return out


@pytest.mark.parametrize("letters", ["ab", "abcdefghé", "abcdefghijklmnopqrstuvwxyzàÿ"])
def test_variants_against_all_pairs(spark, letters, monkeypatch):
    monkeypatch.setattr(spelling, "FREQUENT", 3)  # long grams are needed
    count = invented(200 if letters == "ab" else 500, letters, len(letters))
    words = spark.createDataFrame(list(count.items()), "word string, n long")
    got = {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.group(words).collect()}
    assert got == grouped(count)


def test_one_edit_leaves_a_rare_gram():
    rng = random.Random(3)
    frequent = frozenset(a + b + c for a in "\x02ab" for b in "ab" for c in ("", "a", "b", "\x03"))
    counts = np.random.default_rng(1).integers(0, 50, spelling.BUCKETS)
    for word in invented(300, "abc", 5):
        for _ in range(4):
            at, c = rng.randrange(len(word)), rng.choice("abc")
            other = rng.choice([word[:at] + word[at + 1:], word[:at] + c + word[at:], word[:at] + c + word[at + 1:]])
            if other == word or len(other) < 5:
                continue
            a, b = spelling.decompose(word, frequent), spelling.decompose(other, frequent)
            shared = sum((collections.Counter(a) & collections.Counter(b)).values())
            assert shared >= max(len(a) - spelling.affected(a), len(b) - spelling.affected(b)) > 0
            assert {g for _, g in spelling.rarest(word, frequent, counts)} & {g for _, g in spelling.rarest(other, frequent, counts)}


def test_the_dictionary_has_a_bound(spark):
    words = spark.createDataFrame([(w,) for w in invented(400, "abcdef", 1)], "word string")
    for most in (5, 40):
        frequent, counts = spelling.dictionary(words, most)
        assert len(frequent) < most and counts.sum() > 0


def test_word_query_against_loops(spark, tmp_path):
    ready(spark)
    rng = random.Random(8)
    pool = ["Hello", "hello", "hallo", "hullo", "worlds", "world", "wörlds", "naïveté", "naivete", "tiny", "apples", "apple", "applés"]
    rows = [(i, " ".join(rng.choice(pool) + rng.choice(["", ",", "1"]) for _ in range(120)), "en", "a", 1) for i in range(30)]
    rows += cases.awkward()
    count: collections.Counter = collections.Counter()
    for key, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            count[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    want = grouped({w: n for w, n in count.items() if len(w) >= 5 and n >= 3})
    folder = cases.write(spark, tmp_path, rows)
    got = queries.QUERIES["op12_gram_index"](spark, folder).collect()
    assert {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got} == want and len(want) > 5


def test_words_of_odd_shape(spark):
    rows = [(None,), ("tiny",), ("words",), ("words",), ("words",), ("\x02word",), ("\x02word",), ("\x02word",)]
    words = spark.createDataFrame(rows, "word string").withColumn("extra", F.lit(1))
    got = {r["word"]: r["n_near"] for r in spelling.group(spelling.vocabulary(words)).collect()}
    assert got == {"words": 0, "\x02word": 0}
    assert spelling.group(spelling.vocabulary(words.limit(0))).collect() == []
    with pytest.raises(ValueError):
        spelling.vocabulary(words, least_length=3)


# --- runs -----------------------------------------------------------------------------------------

def all_runs(w: list, least: int = 24, cube: int = 3):
    n, out = len(w), []
    for q in range(1, n // cube + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - start
            smaller = any(all(w[k] == w[k + p] for k in range(start, start + length - p)) for p in range(1, q))
            if length >= max(least, cube * q) and not smaller:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(seed: int, size: int = 160) -> list[str]:
    rng, out = random.Random(seed), []
    while len(out) < size:
        part = [rng.choice("abcd") for _ in range(rng.randrange(1, 12))]
        times = rng.choice([1, 1, 3, 4, 9])
        out += (part * times)[:len(part) * times - rng.randrange(len(part))]
    return out


def test_tree_against_sorted_suffixes():
    rng = random.Random(1)
    for size in (1, 2, 3, 20, 90):
        for letters in (1, 2, 3):
            ids = [rng.randrange(letters) for _ in range(size)]
            tree = periods.SuffixTree(ids)
            places = sorted(range(size + 1), key=lambda i: ids[i:])
            assert np.argsort(tree.rank).tolist() == places
            assert np.argsort(tree.reversed_rank).tolist() == sorted(range(size + 1), key=lambda i: [-x for x in ids[i:]])
            pairs = np.array([(i, j) for i in range(size + 1) for j in range(size + 1) if i != j])
            want = []
            for i, j in pairs:
                k = 0
                while max(i, j) + k < size and ids[i + k] == ids[j + k]:
                    k += 1
                want.append(k)
            assert tree.common(pairs[:, 0], pairs[:, 1]).tolist() == want


@pytest.mark.parametrize("least, cube", [(2, 2), (6, 3), (24, 3)])
def test_runs_against_their_definition(least, cube):
    for seed in range(25):
        words = periodic(seed)
        ids = {w: i for i, w in enumerate(sorted(set(words)))}
        got = [tuple(r) for r in periods.runs_of([ids[w] for w in words], least, cube).tolist()]
        assert sorted(got, key=lambda r: (r[0], r[2])) == all_runs(words, least, cube)
    assert periods.runs_of([], 2, 2).tolist() == []


def expected(key, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(("" if key is None else str(key)).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs, lost = all_runs(words), set()
    for s, length, q in runs:
        lost |= set(range(s + q, s + length))
    top = None
    for r in runs:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (key, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in lost)))


def test_period_query_against_the_definition(spark, tmp_path):
    ready(spark)
    rng = random.Random(5)
    rows = [r for r in cases.awkward() if r[0] != 4]
    for i in range(100, 260):
        text = " ".join(periodic(i, rng.randrange(1, 300))) if i % 2 else cases.prose(i, rng.randrange(1, 200))
        rows.append((i, rng.choice(["", " ", "\n"]) + text + rng.choice(["", " \t", "\n\n"]), "en", "a", 1))
    rows.append((300, "中文   x " * 20, "en", "a", 1))
    got = queries.QUERIES["op13_periods"](spark, cases.write(spark, tmp_path, rows)).collect()
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    want = [expected(*r[:2]) for r in rows]
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got))) == sorted(map(str, want))
    assert sum(w[1] for w in want) > 100


def test_awkward_runs(spark):
    rows = cases.awkward() + [(70, "a b " * 5000, "en", "a", 1)]
    got = periods.find(clashing(cases.frame(spark, rows, clash=True))).collect()
    assert len(got) == len(rows) and {r["size"] for r in got} == {"mine size"}
    told = {r["doc_id"]: r for r in got}
    assert told[70]["runs"] == [(0, 10000, 2)] and told[70]["collapsed"] == "a b" and told[1]["runs"] == []
    assert periods.find(cases.frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        periods.find(cases.frame(spark, rows), least=5)
