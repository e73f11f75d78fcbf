"""Row-wise operators, sharding, mixing and the pipeline."""

from __future__ import annotations

import collections
import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import cases
from tests.llm.test_pairs import WORD, alike, removed
from ventide.llm import bpe, langid, mixing, pages, queries, rules, sharding, toolcalls
from ventide.llm.tables import ready

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def awkward_dir(spark, tmp_path_factory):
    return cases.write(ready(spark), tmp_path_factory.mktemp("awkward"), cases.awkward())


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    cases.write(ready(spark), folder, [])
    for name, shape in (("pages", "page_id long, url string, html string"),
                        ("embeddings", "vec_id long, embedding array<float>"),
                        ("conversations", "conv_id long, turn long, role string, text string")):
        spark.createDataFrame([], shape).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_of_empty_tables(spark, empty_dir, name):
    got = queries.QUERIES[name](spark, empty_dir)
    assert got.collect() == [] and len(got.columns) == len(set(got.columns))


# --- tokens ---------------------------------------------------------------------------------------

def test_tokens_equal_the_reference_and_decode_back(spark, awkward_dir, reference):
    got = queries.QUERIES["op5_bpe"](spark, awkward_dir).collect()
    want = []
    for key, text, *_ in cases.awkward():
        ids = reference.encode_ordinary(text or "")
        want.append((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)


def test_tokens_of_random_strings(reference):
    codec, rng = bpe.codec(PATH, PATTERN), random.Random(3)
    parts = ["a", "aa", "the", " ", "  ", "\n", "\t ", "é", "中文", "'s", "'", "...", "\U0001f600", "12", "٣", " ", "\x85", "\x1c", "--", "Ünder"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) * rng.choice([1, 1, 1, 2, 9]) for _ in range(rng.randrange(12)))
        assert codec.encode(text).tolist() == reference.encode_ordinary(text), ascii(text)
        rows = codec.encode(text, True)
        assert rows[:, 0].tolist() == codec.encode(text).tolist()
        assert bpe.decode_ids(PATH, rows[:, 0].tolist()) == text.encode()


def test_matches_are_kept_not_the_chunks_they_stand_in(reference):
    words = ["".join(random.Random(i).choices("abcdefghij", k=9)) for i in range(60)]
    text = " ".join(f"{a}.{b}" for a in words for b in words)
    codec = bpe.Codec(PATH, PATTERN)
    assert codec.encode(text).tolist() == reference.encode_ordinary(text)
    assert len(codec.known) <= 2 * len(words) + 1  # with a blank and without, and the dot


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 1}, {"BLOCK": 40, "KEPT": 30}, {"KEPT": 0, "LONGEST": 2}])
def test_tokens_of_columns(reference, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(bpe, name, value)
    spaces = [c for c in map(chr, range(0x3001)) if c.isspace()]
    parts = ["a", "the", " ", " ", " ", "  ", " x", "é", "à", "…", "”", "は", "、", "中文", "'s", "\U0001f600", "12", "\x00", "\u180e", "\u200b", *spaces]
    rng, codec = random.Random(5), bpe.Codec(PATH, PATTERN)
    texts = [None, "", " ", None, *("".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(1500)), "", "a" * 99]
    for column in (pa.array(texts, pa.string())[2:], pa.array(texts, pa.large_string()), pa.array([None, ""], pa.string()),
                   pa.array([], pa.string())):
        want = [reference.encode_ordinary(text or "") for text in column.to_pylist()]
        ids, sizes = codec.encode_all(column)
        assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]
        rows, sizes = codec.encode_all(column, True)
        assert rows[:, 0].tolist() == ids.tolist() and sizes.tolist() == [len(w) for w in want]
        begin = 0
        for text, size in zip(column.to_pylist(), sizes.tolist()):
            spans = rows[begin:begin + size, 1:].tolist()
            assert {i for a, b in spans for i in range(a, b)} == set(range(len(text or ""))) and spans == sorted(spans)
            assert all(a < b for a, b in spans)
            begin += size


def test_token_offsets_cover_split_characters(spark):
    df = cases.frame(ready(spark), [(1, "ab \U0001f9ff cd", "x", "y", 1)], clash=True)
    row = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH).first()
    assert row["decoded_text"] == row["text"] == "ab \U0001f9ff cd" and row["kept"] == "mine kept"
    spans = list(zip(row["starts"], row["ends"]))
    assert [row["text"][a:b] for a, b in spans][0] == "ab" and spans[-1][1] == len(row["text"])
    split = [s for s in spans if "\U0001f9ff" in row["text"][s[0]:s[1]]]
    assert len(split) > 1  # several tokens, each covering the one character


# --- rules ----------------------------------------------------------------------------------------

def measured(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered))


def test_rules_measure_what_a_loop_measures(spark):
    rng = random.Random(8)
    rows = cases.awkward() + [
        (100 + i, "\n".join(rng.choice(["same line here", cases.prose(i, 9), "", " ", "| a | b #", "SHOUT!! LOUD!!"])
                            for _ in range(rng.randrange(1, 30))) * rng.choice([1, 1, 2]), "en", "s", 1) for i in range(120)]
    book = rules.verdict(rules.ledger(cases.frame(ready(spark), rows, clash=True)))
    got = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in book.collect()]
    assert collections.Counter(got) == collections.Counter((r[0], *measured(r[1])) for r in rows)
    for r in book.collect():
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (r["failed"] & rules.POLICIES["v2"] == 0) and not (r["base_failed"] and r["kept"])


def test_ablation_counts_by_bits(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(
        [cases.prose(1, 50), "few words", cases.prose(2, 40) + " ***" * 30, "no !! " * 2, cases.prose(3, 50)])]
    book = rules.ledger(cases.frame(ready(spark), rows))
    got = {r["rule"]: (r["failed"], r["failed_alone"], r["kept_without"]) for r in rules.ablation(book).collect()}
    bits = [r["failed"] for r in book.collect()]
    for rule, bit in rules.BIT.items():
        assert got[rule] == (sum(b & bit > 0 for b in bits), sum(b == bit for b in bits), sum(b & ~bit == 0 for b in bits))
    assert rules.POLICIES["v1"] & rules.POLICIES["v2"] == rules.POLICIES["v1"]


# --- language -------------------------------------------------------------------------------------

STEMS = {"en": ["the", "ing", "th", "wh", "sh", "of", "and"], "fr": ["eau", "é", "ou", "qu", "le", "ent", "aux"],
         "de": ["sch", "ung", "ch", "der", "ei", "ü", "keit"]}


def spoken(seed, lang, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def test_language_is_learned_on_one_fold_and_right_on_the_other(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, spoken(i, lang, rng.choice([4, 20, 200])), lang, "s", 1)
            for i, lang in enumerate(rng.choice(["en", "fr", "de"]) for _ in range(240))]
    # A held-out document's label is never seen: give them all a false one.
    shown = [(i, t, lang if zlib.crc32(str(i).encode()) % 5 else "xx", s, n) for i, t, lang, s, n in rows]
    got = queries.QUERIES["op9_langid"](ready(spark), cases.write(spark, tmp_path, shown)).collect()
    right = {r[0]: r[2] for r in rows}
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in right if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["lang_pred"] == right[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in STEMS for r in got)


def test_language_of_awkward_rows(spark, awkward_dir):
    got = queries.QUERIES["op9_langid"](spark, awkward_dir).collect()
    assert len(got) == len(cases.awkward())
    for r in got:
        texts = [t for k, t, *_ in cases.awkward() if k == r["doc_id"]]
        if all(not any(c.isalpha() for c in t or "") for t in texts):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    model = langid.train(cases.frame(spark, []))
    assert model.predict(["some text", None])[0] == ["und", "und"]


def test_temperature_softens_wrong_certainty():
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 2, 400)
    logits = np.zeros((400, 2))
    logits[np.arange(400), np.where(rng.random(400) < 0.8, labels, 1 - labels)] = 9.0  # right four times in five
    p = langid.softmax(np.array([9.0, 0.0]) / langid.temperature_of(logits, labels))[0]
    assert abs(p - 0.8) < 0.05


# --- pages ----------------------------------------------------------------------------------------

def test_page_model_on_layouts_it_has_not_seen():
    rng = np.random.default_rng(1)
    texts = [[cases.prose(i * 9 + j, n) + "." for j, n in enumerate([6, 40, 25, 60, 12])] for i in range(40)]
    rest = [cases.prose(1000 + i, n) for i, n in enumerate([3, 8, 15, 30] * 10)]
    made = [pages.parse(pages.compose(rng, texts[i % 40], rest), labelled=True)[0] for i in range(300)]
    model = pages.fit(made)
    test = [pages.parse(pages.compose(np.random.default_rng(10_000 + i), texts[i % 40], rest), labelled=True)[0] for i in range(80)]
    forest = pages.Forest(test)
    belief, _ = forest.marginals(model.unary, model.edges)
    assert ((belief[:, 1] > np.log(0.5)) == forest.labels).mean() > 0.97
    assert np.allclose(np.exp(belief).sum(axis=1), 1)


def test_messages_equal_enumeration():
    nodes = pages.parse("<div><p>one two</p><section class=ad><p>x</p></section></div>")[0]
    forest = pages.Forest([nodes])
    rng = np.random.default_rng(3)
    unary, edges = rng.standard_normal(len(pages.FLAGS) + pages.HASHED), rng.standard_normal((pages.EDGE_KINDS, 4))
    n = len(nodes)
    own = np.bincount(forest.owner, unary[forest.feature], n)
    total, on = 0.0, np.zeros(n)
    for state in np.ndindex(*[2] * n):
        score = sum(own[i] for i in range(n) if state[i])
        for owner, kind in zip(forest.edge_owner, forest.kind):
            if forest.parent[owner] >= 0:
                score += edges[kind, 2 * state[forest.parent[owner]] + state[owner]]
        total += np.exp(score)
        on += np.array(state) * np.exp(score)
    assert np.allclose(np.exp(forest.marginals(unary, edges)[0][:, 1]), on / total)


def test_parser_repairs_markup():
    nodes, text = pages.parse("<p><b>a<br>b<p>c &amp;amp; d<ul><li>x<li>y</ul><script>if(a<b){'<p>'}</script>e<!-- no --><textarea><p></textarea>")
    joined = [" ".join("".join(n.pieces).split()) for n in nodes]
    assert [(n.tag, t) for n, t in zip(nodes, joined)] == [
        ("#page", "e"), ("p", "a b"), ("p", "c &amp; d"), ("ul", ""), ("li", "x"), ("li", "y"), ("textarea", "<p>")]
    assert pages.parse("")[1] == [] and pages.parse("<" * 50)[1] == [(0, "<" * 50)]


@pytest.mark.parametrize("html", [
    *(f"<p>a</p>{hides}<p>b</p>" for hides in (
        '<svg class="i"/>', "<math/>", "<template/>", '<object data="x" />', "<script src=x />", "<script src=x /></script>",
        "<script src=/x/>var c</script>", "<svg><path/>c</svg>", "<title/>")),
    "<html><head><title>c</title><body><p>a</p><p>b</p></body></html>", "<head><meta x><link y><p>a</p><p>b</p>",
    "<head><style>c</style><script/>c</script>a <img>b", "<head><title>c</title></head><p>a</p>b"])
def test_parser_hides_no_more_than_what_is_hidden(html):
    assert " ".join("".join(f" {t}" for _, t in pages.parse(html)[1]).split()) == "a b"


@pytest.mark.parametrize("mark", ['data-y="12px"', 'data-y=""', "data-y=12.5", 'data-y="0"', 'data-y="1"'])
def test_the_trainers_mark_means_nothing_in_a_page(spark, mark):
    html = f"<html><body {mark}><nav {mark}><a href=x>Home</a></nav><article {mark}><p>{cases.prose(5, 60)}.</p></article></body></html>"
    assert {n.label for n in pages.parse(html)[0]} == {None}
    df = ready(spark).createDataFrame([(1, html)], "page_id long, html string")
    assert pages.main_text(df, pages.train(df, composed=200)).first()["text"] == cases.prose(5, 60) + "."


def test_extraction_equals_enumeration():
    """`extract` against all labellings of small pages: the blocks whose marginal is above one half."""
    rng = np.random.default_rng(8)
    model = pages.Model(rng.standard_normal(len(pages.FLAGS) + pages.HASHED), rng.standard_normal((pages.EDGE_KINDS, 4)))
    htmls = ["<p>one</p>two<div>three <b>four</b></div>", "a<ul><li>b</li><li>c d</li></ul>e", "<nav>x</nav><p>y &amp; z</p><p></p>q"]
    for html, got in zip(htmls, pages.extract(model, htmls)):
        nodes, text = pages.parse(html)
        forest = pages.Forest([nodes])
        own = np.bincount(forest.owner, model.unary[forest.feature], len(nodes))
        total, on = 0.0, np.zeros(len(nodes))
        for state in np.ndindex(*[2] * len(nodes)):
            score = sum(own[i] for i in range(len(nodes)) if state[i]) + sum(
                model.edges[kind, 2 * state[forest.parent[o]] + state[o]]
                for o, kind in zip(forest.edge_owner, forest.kind) if forest.parent[o] >= 0)
            total += np.exp(score)
            on += np.array(state) * np.exp(score)
        blocks, last = [], None
        for block, piece in text:
            if on[block] > total / 2:
                blocks.append(piece if block != last else blocks.pop() + piece)
            last = block if piece.strip() or block == last else None
        assert got == " ".join(" ".join(blocks).split())


def test_pages_with_nulls_and_clashing_columns(spark):
    rows = [(1, "u", "<html><body><nav><a href=x>Home</a></nav><article><h1>Title of it</h1><p>" + cases.prose(5, 60)
             + ".</p></article></body></html>"), (2, None, None), (3, "", ""), (None, None, "<p>"), (1, "u", "")]
    df = ready(spark).createDataFrame(rows, "page_id long, url string, html string")
    model = pages.train(df, composed=200)
    got = pages.main_text(df.withColumn("text", F.lit(1)), model).collect()
    assert [r["text"] for r in got] == ["Title of it " + cases.prose(5, 60) + ".", "", "", "", ""]


# --- sharding -------------------------------------------------------------------------------------

def test_schedule_is_longest_first_to_the_least_loaded():
    sizes = [(f"g{i}", s) for i, s in enumerate([9, 7, 7, 5, 4, 4, 3, 1])]
    placed, loads = sharding.schedule(sizes, 3), [0, 0, 0]
    for name, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        least = loads.index(min(loads))
        assert placed[name] == least
        loads[least] += size
    assert max(loads) - min(loads) <= 1


def test_shards_keep_groups_fill_slots_and_balance(spark, tmp_path):
    rng = random.Random(2)
    texts = [cases.prose(i, rng.randrange(1, 120)) for i in range(900)]
    rows = [(i, rng.choice(texts) if rng.random() < 0.7 else texts[0], "en", "s", 1) for i in range(3000)]
    rows += [r for r in cases.awkward() if r[0] != 4]
    got = queries.QUERIES["op6_sharding"](ready(spark), cases.write(spark, tmp_path, rows)).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"bytes"}
    by_text = collections.defaultdict(set)
    loads, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        by_text[r["text_crc32"], r["size"]].add(r["shard"])
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < 40 and r["grown_shard"] is None
    want = collections.Counter((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t, *_ in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for (crc, _), s in by_text.items() if crc)
    others = sorted(loads.values())[:-1]  # the hot text fills one shard by itself
    assert max(others) - min(others) <= 0.15 * max(others)


# --- mixing ---------------------------------------------------------------------------------------

def test_mix_meets_its_targets(spark):
    rng = random.Random(4)
    sizes = {"a": 4000, "b": 300, "c": 700, None: 200, "zero": 30}
    rows = [(i, "" if s == "zero" else cases.prose(i, rng.randrange(1, 60)), "en", s, 1)
            for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    mixed = mixing.mix(cases.frame(ready(spark), rows, clash=True)).collect()
    assert len(mixed) == len(rows)
    source = {}
    for r in mixed:
        x = source.setdefault(r["source"], {"size": 0, "taken": 0, "target": r["target"], "told": r["source_size"]})
        x["size"] += r["size"]
        x["taken"] += r["size"] * r["copies"]
        assert r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) and r["copies"] <= 3
    total = sum(x["size"] for x in source.values())
    # By hand: raise the level until the capped targets use everything up.
    weight = dict(zip(["a", "b", "c", "zero", None], [5, 2, 1, 5, 2]))
    low, high = 0.0, float(total)
    for _ in range(200):
        level = (low + high) / 2
        used = sum(min(3 * x["size"], level * weight[s]) for s, x in source.items())
        low, high = (level, high) if used < total else (low, level)
    for s, x in source.items():
        assert x["told"] == x["size"] and x["target"] == pytest.approx(min(3 * x["size"], low * weight[s]), rel=1e-9, abs=1e-6)
        assert abs(x["taken"] - x["target"]) <= 0.12 * x["target"]
    again = mixing.mix(cases.frame(spark, rows, clash=True).repartition(7)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in again) == sorted((r["doc_id"], r["copies"]) for r in mixed)
    emitted = mixing.emit(mixing.mix(cases.frame(spark, rows))).groupBy("doc_id").agg(F.max("copy").alias("m"), F.count("*").alias("n"))
    assert all(r["m"] == r["n"] for r in emitted.collect())


def test_mix_of_awkward_rows(spark):
    rows = cases.awkward()
    mixed = mixing.mix(cases.frame(ready(spark), rows)).collect()
    assert sorted(r["size"] for r in mixed) == sorted(len(WORD.findall(r[1] or "")) for r in rows)
    assert len({r["copies"] for r in mixed if r["doc_id"] == 9}) == 1


# --- tool calls -----------------------------------------------------------------------------------

def test_tool_calls_are_linked_ordered_checked_and_written(spark):
    ready(spark)
    calls = spark.createDataFrame([
        (1, "a", 0, "search", '{"limit": 3, "query": "x"}'), (1, "b", 2, "search", '{"query":"${a} ${c}","limit":1}'),
        (1, "c", 4, "translate", '{"query":"${a}","lang":"en","z":[1,{"k":2,"a":1.50}]}'), (1, "c", 5, "search", "{}"),
        (1, "d", 6, "search", "not json"), (1, None, 7, "search", None), (1, "e", 8, "search", '{"limit":"1","query":"${gone}"}'),
        (2, "a", 0, "search", '{"limit":1,"query":"${b}"}'), (2, "b", 1, "search", '{"limit":1,"query":"${a}"}'),
        (2, "f", 3, "odd", None), (2, "f", 3, "odd", None), (None, "a", 0, "search", "{}"),
    ], "conv long, id string, turn long, name string, arguments string").withColumn("status", F.lit("mine"))
    results = spark.createDataFrame([
        (1, "a", 1, 'he said "é"\n'), (1, "a", 3, "late"), (1, "zz", 9, None), (2, "a", 5, "r"), (None, None, None, None),
    ], "conv long, id string, turn long, content string")
    rows = toolcalls.format_calls(calls, results, toolcalls.schema_table(spark)).collect()
    got = {(r["conv"], r["id"], r["turn"], r["status"]): (r["level"], ",".join(r["errors"])) for r in rows}
    assert got == {
        (1, "a", 0, "ok"): (0, ""), (1, "a", 3, "duplicate_result"): (None, ""),
        (1, "b", 2, "no_result"): (1, ""), (1, "c", 4, "no_result"): (0, "unexpected:z"),
        (1, "c", 5, "duplicate_call"): (None, ""), (1, "d", 6, "no_result"): (0, "not_an_object"),
        (1, None, 7, "no_id"): (None, ""), (1, "e", 8, "no_result"): (0, "reference:gone,type:limit"),
        (1, "zz", 9, "orphan_result"): (None, ""), (2, "a", 0, "ok"): (None, ""), (2, "b", 1, "no_result"): (None, ""),
        (2, "f", 3, "no_result"): (0, "not_an_object"), (2, "f", 3, "duplicate_call"): (None, ""),
        (None, "a", 0, "no_id"): (None, ""), (None, None, None, "no_id"): (None, "")}
    written = {(r["conv"], r["id"], r["status"]): r["json"] for r in rows}
    assert written[1, "a", "ok"] == '{"arguments":{"limit":3,"query":"x"},"id":"a","name":"search","result":"he said \\"é\\"\\n"}'
    assert written[1, "c", "no_result"].startswith('{"arguments":{"lang":"en","query":"${a}","z":[1,{"a":1.5,"k":2}]}')
    assert all(json.loads(r["json"])["id"] == r["id"] for r in rows)


def test_levels_make_any_chain_a_topological_order(spark):
    """Long chains back take no round; chains ahead, mixed chains and cycles are told apart."""
    rng, rows, needs = random.Random(3), [], {}
    for turn in range(300):  # only back
        needs["long", f"k{turn}"] = [f"k{turn - 1}"] if turn else []
    for turn in range(40):  # some ahead, without a cycle: references follow a hidden order
        needs["mixed", f"k{turn}"] = []
    hidden = list(range(40))
    rng.shuffle(hidden)
    for place, turn in enumerate(hidden):
        needs["mixed", f"k{turn}"] = [f"k{t}" for t in rng.sample(hidden[:place], min(place, rng.randrange(3)))]
    for turn, other in ((0, [2]), (1, [0]), (2, [1]), (3, [2]), (4, [])):
        needs["cycle", f"k{turn}"] = [f"k{t}" for t in other]
    conv = {"long": 1, "mixed": 2, "cycle": 3}
    for (name, key), wanted in needs.items():
        rows.append((conv[name], key, int(key[1:]), "search", json.dumps({"limit": 1, "query": " ".join("${%s}" % w for w in wanted)})))
    calls = ready(spark).createDataFrame(rows, "conv long, id string, turn long, name string, arguments string")
    results = spark.createDataFrame([], "conv long, id string, turn long, content string")
    got = {(r["conv"], r["id"]): r for r in toolcalls.order(toolcalls.link(calls, results)).collect()}
    for (name, key), wanted in needs.items():
        me = got[conv[name], key]
        if name == "cycle":
            assert (me["level"] is None) == (key != "k4")
            continue
        for w in wanted:
            it = got[conv[name], w]
            assert (it["level"], it["turn"], it["id"]) < (me["level"], me["turn"], me["id"])
    assert {got[1, f"k{t}"]["level"] for t in range(300)} == {0}


# --- pipeline -------------------------------------------------------------------------------------

def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path, reference):
    rng = random.Random(6)
    rows = []
    for i in range(90):
        lang = rng.choice(["en", "fr", "de"])
        rows.append((i, spoken(i, lang, rng.randrange(30, 90)), lang, f"s{i % 3}", 1))
    rows += [(100 + i, rows[i][1], rows[i][2], "s1", 1) for i in range(0, 90, 9)]  # copies
    rows += [(200 + i, rows[i][1] + " and more", rows[i][2], None, 1) for i in range(1, 90, 9)]  # near copies
    passage = spoken(999, "en", 70)
    rows += [(300 + i, spoken(500 + i, "en", 60) + " " + passage, "en", "s2", 1) for i in range(6)]
    rows += [(400, None, "en", "s0", None), (401, "12 34", None, None, 5), (402, "", "en", "s0", 0), (88, *rows[88][1:])]
    folder = cases.write(ready(spark), tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    first = corpus_pipeline.language(spark, docs, folder)
    assert first.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in first.collect()) == collections.Counter(r[0] for r in kept)
    label = {k: c for k, _, c in alike(sorted({r[:2] for r in kept}))}
    kept = sorted({r for r in kept if label[r[0]] == r[0]})
    second = corpus_pipeline.near_duplicates(spark, first, folder)
    assert sorted(r["doc_id"] for r in second.collect()) == [r[0] for r in kept]
    third = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, second, folder).collect()}
    assert all(hashlib.sha256(third[k].encode()).hexdigest() == digest or "�" not in third[k]
               for k, _, _, _, digest in removed([r[:2] for r in kept]))
    assert third[300].endswith(passage) and not any(passage in third[300 + i] for i in range(1, 6))
    got = corpus_pipeline.run(spark, folder).collect()
    copies = collections.Counter(r["doc_id"] for r in got)
    assert set(copies) <= set(third) and max(copies.values()) <= 3
    for r in got:
        ids = reference.encode_ordinary(third[r["doc_id"]])
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(third[r["doc_id"]].encode()).hexdigest()


def test_tables_on_the_way_do_not_stay(spark, tmp_path, monkeypatch):
    from ventide.llm import suffix, tables
    monkeypatch.setattr(tables, "shared_folder", lambda spark, name: f"{tmp_path}/{name}")
    long = "a passage that comes twice and is longer than any hundred bytes that are looked at, word after word, to the end. "
    docs = spark.createDataFrame([(1, long + "one"), (2, "two " + long), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: bytes(r.kept_bytes) for r in suffix.cut(docs).collect()}
    assert rows[1] == (long + "one").encode() and len(rows[2]) < 20 and rows[3] == b""
    assert sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()) == ["repeated-keys", "spans"]
    assert not tables._ON_THE_WAY
