"""Registered queries over text and vectors.

A document's `source` is the guideline document, a row of `documents` one of its pages.
Lines shorter than forty characters count as set in the heading font.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventide.functions import textfn as T
from ventide.operators import corpus, retrieval
from ventide.plans.sources_sql import with_sources
from ventide.plans.timeseries import r
from ventide.session import materialize, spread
from ventide.sources import testdata as TD

_ROLE = ("CASE cast(substr(source, 4) as int) % 3 WHEN 0 THEN 'protocol' WHEN 1 THEN 'guideline'"
         " ELSE 'surveillance' END")


def pages(spark, sf) -> DataFrame:
    return spread(TD.table(spark, sf, "documents")).selectExpr(
        "source AS doc_key", f"{_ROLE} AS role", "doc_id AS page", "text")


def lines(spark, sf) -> DataFrame:
    short = F.length("text") < 40
    return corpus.page_lines(pages(spark, sf)).select(
        "doc_key", "role", "page", "line_no", T.repair_glyphs(F.col("text")).alias("text"),
        F.when(short, 14.0).otherwise(10.0).alias("size"), F.lit(False).alias("bold"),
        F.when(short, "head").otherwise("body").alias("font"))


def registry(spark, sf) -> DataFrame:
    return TD.table(spark, sf, "documents").select("source").distinct().selectExpr(
        "source AS doc_key", "concat('Document ', source) AS title",
        "concat('Guideline ', source) AS cite")


def chunks(spark, sf) -> DataFrame:
    clean = materialize(corpus.strip_boilerplate(lines(spark, sf)))
    placed = materialize(corpus.heading_paths(materialize(corpus.tag_headings(clean))))
    both = corpus.chunk_lines(placed).unionByName(corpus.graded_statements(placed))
    return corpus.number_chunks(materialize(corpus.drop_duplicates(both)), registry(spark, sf))


def benchmark_keys(spark, sf) -> DataFrame:
    """One key per benchmark item: its distinct three-word phrases."""
    words = retrieval.index_tokens(F.col("text"))
    grams = F.array_distinct(retrieval._runs(F.col("_w"), 3))
    return TD.table(spark, sf, "benchmark").withColumn("_w", words).select(
        F.concat(F.lit("item:"), F.col("item_id").cast("string")).alias("key"),
        F.when(F.col("item_id") % 2 == 0, "context").otherwise("actions").alias("channel"),
        F.col("item_id").cast("string").alias("label"), grams.alias("terms"),
        F.lit("").alias("query"))


def page_chunks(spark, sf) -> DataFrame:
    return spread(TD.table(spark, sf, "documents")).selectExpr(
        "doc_id AS chunk_id", "concat('Document ', source) AS title", "text")


def q_line_shapes(spark, sf):
    text = F.trim("text")
    shaped = corpus.page_lines(pages(spark, sf)).select(
        "doc_key", T.table_like(text).alias("t"), T.heading_like(text).alias("h"),
        (T.numeric_share(text) >= 0.25).alias("d"), text.rlike(T.ROMAN).alias("r"),
        text.rlike(T.OUTLINE).alias("o"), T.word_count(text).alias("w"),
        T.line_key(T.mask_digits(text)).alias("k"))
    return shaped.groupBy("doc_key").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if("t").alias("table_like"),
        F.count_if("h").alias("heading_like"), F.count_if("d").alias("numeric_dense"),
        F.count_if("r").alias("roman"), F.count_if("o").alias("outline"),
        F.sum("w").cast("long").alias("words"), F.countDistinct("k").alias("line_keys"))


def web_lines(spark, sf) -> DataFrame:
    """Markup lines of the web pages; the language stands for the document."""
    return corpus.page_lines(TD.table(spark, sf, "pages").selectExpr(
        "regexp_extract(html, 'lang=\"(..)', 1) AS doc_key", "page_id AS page",
        "replace(html, '<', '\\n<') AS text"))


def q_boilerplate(spark, sf):
    return corpus.boilerplate_keys(web_lines(spark, sf))


def q_stripped_lines(spark, sf):
    kept = corpus.strip_boilerplate(web_lines(spark, sf))
    return kept.groupBy("doc_key").agg(F.count(F.lit(1)).alias("lines"),
                                       F.sum(F.length("text")).alias("chars"))


def _broken(spark, sf) -> DataFrame:
    """Lines in which every long word carries a soft break after six letters."""
    return corpus.page_lines(pages(spark, sf)).withColumn(
        "text", F.regexp_replace("text", "([A-Za-z]{6})([A-Za-z]{6,})", f"$1{T.SOFT_BREAK}$2"))


def q_soft_breaks(spark, sf):
    rows = _broken(spark, sf)
    return corpus.resolve_breaks(corpus.break_pairs(rows), corpus.vocabulary(rows))


def q_repaired_breaks(spark, sf):
    rows = _broken(spark, sf)
    resolved = corpus.resolve_breaks(corpus.break_pairs(rows), corpus.vocabulary(rows))
    fixed = corpus.repair_breaks(rows, resolved, ["doc_key", "page", "line_no"])
    return fixed.groupBy("doc_key").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"),
        F.count_if(F.col("text").contains(T.SOFT_BREAK)).alias("unresolved"))


def q_glyph_repair(spark, sf):
    """Digits in styled letters and wrong equals signs put in, then repaired."""
    styled = F.regexp_replace("text", "e", T.BAD_EQUALS)
    styled = F.regexp_replace(styled, r"\bthe\b|\bth¼\b", "\U0001d465\U0001d466")
    return pages(spark, sf).select("page", T.repair_glyphs(styled).alias("text")).select(
        F.col("page").alias("doc_id"), F.length("text").alias("chars"),
        (F.length("text") - F.length(F.replace("text", F.lit("="), F.lit("")))).alias("equals"),
        (F.size(F.split("text", "xy", -1)) - 1).cast("long").alias("folded"))


def q_vocabulary(spark, sf):
    return corpus.vocabulary(corpus.page_lines(pages(spark, sf)))


def q_heading_levels(spark, sf):
    tagged = corpus.tag_headings(corpus.strip_boilerplate(lines(spark, sf)))
    return tagged.groupBy("doc_key", "level").agg(F.count(F.lit(1)).alias("lines"))


def q_chunks(spark, sf):
    return chunks(spark, sf).select(
        "chunk_id", "doc_key", F.col("page").cast("long").alias("page"), "title", "kind",
        "citation", "words", F.sha2("text", 256).alias("digest"))


def q_corpus_report(spark, sf):
    return corpus.corpus_report(chunks(spark, sf))


def q_graded(spark, sf):
    """Every line ends in a graded recommendation, with verb, strength and certainty by page and
    line; all of them are found again in the page texts."""
    pick = lambda *options: F.element_at(F.array(*map(F.lit, options)), (
        (F.col("page") + F.col("line_no")) % len(options) + 1).cast("int"))
    rows = corpus.page_lines(pages(spark, sf)).select(
        "doc_key", F.lit("guideline").alias("role"), "page", "line_no",
        F.concat("text", F.lit(" We "), pick("recommend", "suggest"), F.lit(" item "),
                 F.col("page").cast("string"), F.lit("-"), F.col("line_no").cast("string"),
                 F.lit(" for all such patients ("), pick("strong", "conditional", "weak"),
                 F.lit(" recommendation, "), pick("very  low", "low", "moderate", "high"),
                 F.lit(" certainty).")).alias("text"),
        F.array(F.col("doc_key")).alias("heading_path"))
    found = corpus.graded_statements(rows)
    return found.groupBy("doc_key", "strength", "certainty").agg(
        F.count(F.lit(1)).alias("statements"))


def q_exact_duplicates(spark, sf):
    key = T.line_key(F.col("text"))
    return TD.table(spark, sf, "documents").groupBy(F.sha2(key, 256).alias("digest")).agg(
        F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))


def q_content_hash(spark, sf):
    documents = TD.table(spark, sf, "documents")
    return corpus.manifest_hash(corpus.source_hashes(documents, "source", "doc_id", "text"))


def q_evidence_keys(spark, sf):
    """How often the pages mention each configured key's anchors."""
    keys = retrieval.key_table(spark)
    wanted = materialize(retrieval.phrases(keys))
    hits = retrieval.bm25(page_chunks(spark, sf), wanted)
    found = hits.groupBy("key").agg(F.count(F.lit(1)).alias("ranked"))
    return keys.join(found, "key", "left").select(
        "key", "channel", F.size("terms").alias("terms"), F.coalesce("ranked", F.lit(0)).alias("ranked"))


def q_bm25(spark, sf):
    wanted = materialize(retrieval.phrases(benchmark_keys(spark, sf)))
    out = retrieval.bm25(page_chunks(spark, sf), wanted)
    return out.select("key", "chunk_id", r("score", 6), F.col("rank").cast("long").alias("rank"))


def q_stemmed_bm25(spark, sf):
    """The same ranking when words agree by their stems."""
    wanted = materialize(retrieval.phrases(benchmark_keys(spark, sf)))
    out = retrieval.bm25(page_chunks(spark, sf), wanted, stems=True)
    return out.select("key", "chunk_id", r("score", 6), F.col("rank").cast("long").alias("rank"))


def centroids(spark, sf) -> DataFrame:
    long = TD.table(spark, sf, "embeddings").select(
        "label", F.posexplode("embedding").alias("i", "x"))
    mean = long.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])
        .alias("embedding"))


def q_dense_topk(spark, sf):
    out = retrieval.dense_topk(spread(TD.table(spark, sf, "embeddings").drop("label")),
                               centroids(spark, sf), "label", "vec_id")
    return out.select(F.col("label").cast("long").alias("label"), "vec_id", r("score", 5))


def q_rrf(spark, sf):
    rows = TD.table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(
        F.max("l_extendedprice").alias("a"), F.max("l_quantity").alias("b"))
    channels = {
        c: retrieval.top_ranked(rows.withColumn("score", F.col(c)), "l_suppkey", "l_partkey", 12)
        for c in ("a", "b")
    }
    out = retrieval.fuse(channels, "l_suppkey", "l_partkey")
    return out.select("l_suppkey", "l_partkey", "score", F.col("channels").cast("long")
                      .alias("channels"))


def evidence(spark, sf, keys=None):
    """Chunks of the corpus, the keys (those of the benchmark if none are given), and their passages."""
    body = materialize(chunks(spark, sf))
    keys = benchmark_keys(spark, sf) if keys is None else keys
    wanted = materialize(retrieval.phrases(keys))
    lexical = materialize(retrieval.bm25(body, wanted, stems=True))
    return body, keys, materialize(retrieval.evidence_map(body, keys, {"lexical": lexical}))


def q_evidence_map(spark, sf):
    return evidence(spark, sf)[2].select(
        "key", "rank", "chunk_id", "kind", "citation", "score", "anchor_hits", "flag")


def q_evidence_status(spark, sf):
    _, keys, passages = evidence(spark, sf)
    return retrieval.key_status(keys, passages).groupBy("channel", "status").agg(
        F.count(F.lit(1)).alias("keys"))


def q_quoted_unchanged(spark, sf):
    body, _, passages = evidence(spark, sf)
    return corpus.quoted_unchanged(passages, body).agg(F.count(F.lit(1)).alias("changed"))


def q_admission(spark, sf):
    """Pages admitted and refused by the registry of documents with over 50 pages."""
    documents = TD.table(spark, sf, "documents")
    known = documents.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n > 50")
    admitted, refused = corpus.admit(documents, known, "source")
    label = lambda df, name: df.agg(F.count(F.lit(1)).alias("pages")).select(
        F.lit(name).alias("decision"), "pages")
    return label(admitted, "admitted").unionByName(label(refused, "refused"))


def q_page_titles(spark, sf):
    """Heading texts in raw web pages, by the same line rules."""
    title = F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)
    clean = T.squeeze(title)
    return TD.table(spark, sf, "pages").select(
        "page_id", T.word_count(clean).cast("long").alias("words"),
        T.line_key(clean).alias("title_key"))


def q_turn_words(spark, sf):
    text = TD.table(spark, sf, "conversations")
    return text.groupBy("role").agg(
        F.count(F.lit(1)).alias("turns"), F.sum(T.word_count(F.col("text"))).cast("long").alias("words"))


QUERIES = {
    "line_shapes": q_line_shapes,
    "boilerplate_keys": q_boilerplate,
    "stripped_lines": q_stripped_lines,
    "soft_breaks": q_soft_breaks,
    "repaired_breaks": q_repaired_breaks,
    "glyph_repair": q_glyph_repair,
    "corpus_vocabulary": q_vocabulary,
    "heading_levels": q_heading_levels,
    "corpus_chunks": q_chunks,
    "corpus_report": q_corpus_report,
    "graded_statements": q_graded,
    "exact_duplicates": q_exact_duplicates,
    "content_hash": q_content_hash,
    "evidence_keys": q_evidence_keys,
    "bm25_topk": q_bm25,
    "stemmed_bm25_topk": q_stemmed_bm25,
    "dense_topk": q_dense_topk,
    "rank_fusion": q_rrf,
    "evidence_map": q_evidence_map,
    "evidence_status": q_evidence_status,
    "quoted_unchanged": q_quoted_unchanged,
    "document_admission": q_admission,
    "page_titles": q_page_titles,
    "turn_words": q_turn_words,
}

# ------------------------------------------------------------------ oracles
LINES = """SELECT source AS doc_key, doc_id AS page, unnest(string_split(replace(text, chr(13) ||
  chr(10), chr(10)), chr(10))) AS text FROM documents"""
_KEY = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"
_MASKED = _KEY.format("regexp_replace(text, '\\d+', '#', 'g')")
_TOK = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda t: t <> '')"
_DENSE = ("CASE WHEN len({0}) > 0 THEN len(list_filter({0}, lambda t: regexp_full_match(t,"
          " '[-+]?[\\d.,:%()/]+'))) / len({0}) ELSE 0 END")
NUMBERED = """SELECT source AS doc_key, doc_id AS page, text,
  generate_subscripts(t, 1) - 1 AS line_no, unnest(t) AS line FROM (SELECT *,
  string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS t FROM documents)"""
_SOFT = T.SOFT_BREAK
_PAIR = f"([A-Za-z]+){_SOFT}\\s*([A-Za-z]+)"
BROKEN = {
    "lines": NUMBERED,
    "broken": "SELECT doc_key, page, line_no, regexp_replace(line, '([A-Za-z]{6})([A-Za-z]{6,})',"
              f" '\\1{_SOFT}\\2', 'g') AS text FROM lines",
    "vocab": "SELECT DISTINCT unnest(regexp_extract_all(lower(regexp_replace(text, '[A-Za-z]*"
             f"{_SOFT}\\s*[A-Za-z]*', ' ', 'g')), '[a-z][a-z\\-]*[a-z]|[a-z]')) AS word FROM broken",
    "hits": f"SELECT doc_key, page, line_no, unnest(regexp_extract_all(text, '{_PAIR}', 0)) AS seen,"
            f" unnest(regexp_extract_all(text, '{_PAIR}', 1)) AS l,"
            f" unnest(regexp_extract_all(text, '{_PAIR}', 2)) AS r FROM broken",
    "rules": "SELECT l, r, CASE WHEN lower(l || r) IN (FROM vocab) THEN 'joined_attested'"
             " WHEN lower(l || '-' || r) IN (FROM vocab) THEN 'hyphen_attested'"
             " WHEN lower(l) IN (FROM vocab) AND lower(r) IN (FROM vocab) THEN 'both_halves_are_words'"
             " ELSE 'default_join' END AS rule FROM (SELECT DISTINCT l, r FROM hits)",
    "glued": "SELECT *, CASE WHEN rule IN ('hyphen_attested', 'both_halves_are_words') THEN '-' ELSE ''"
             " END AS glue FROM rules",
}


def _key_phrases() -> str:
    """The configured keys and their token phrases as rows."""
    rows = []
    for k in retrieval.enumerate_keys():
        parts = {" ".join(re.findall("[a-z0-9]+", t.lower())) for t in (*k["terms"], *k["query"].split())}
        rows += [f"('{k['key']}', '{k['channel']}', {len(k['terms'])}, '{p}')" for p in sorted(parts - {""})]
    return ", ".join(rows)


# SHORT_TOKENS with word boundaries spelled out, because here they would know ASCII letters only.
_W = "\\p{L}\\p{N}_"
_SHORT = (f"(?:(?:^|[^{_W}])[{_W}](?:\\S{{0,2}}[{_W}])?|[{_W}][^{_W}\\s]\\S{{0,2}}[{_W}])[ ]+"
          "(?:\\S{1,4}[ ]+){3,}")
BOILER = """SELECT k.doc_key, k.key, on_pages, pages FROM
  (SELECT doc_key, key, count(DISTINCT page) AS on_pages FROM keyed GROUP BY ALL) k
  JOIN (SELECT doc_key, count(DISTINCT page) AS pages FROM keyed GROUP BY ALL) p USING (doc_key)
  WHERE pages >= 4 AND on_pages >= greatest(3, floor(pages * 0.25)) AND length(key) BETWEEN 1 AND 90"""
WEB = """SELECT regexp_extract(html, 'lang="(..)', 1) AS doc_key, page_id AS page,
  unnest(string_split(replace(html, '<', chr(10) || '<'), chr(10))) AS text FROM pages"""
KEYED = {"lines": WEB, "keyed": f"SELECT *, {_MASKED} AS key FROM lines", "boiler": BOILER}
_GRAMS = """SELECT DISTINCT 'item:' || item_id AS key, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS phrase
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 1)) AS i FROM (
    SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark))"""
BM25 = {
    "wanted": _GRAMS,
    "toks": "SELECT doc_id AS chunk_id, regexp_extract_all(lower('Document ' || source), '[a-z0-9]+')"
            " AS t, regexp_extract_all(lower(text), '[a-z0-9]+') AS b FROM documents",
    "lens": "SELECT chunk_id, len(t) + len(b) AS len FROM toks",
    "runs": "SELECT chunk_id, b[i] || ' ' || b[i + 1] || ' ' || b[i + 2] AS phrase FROM"
            " (SELECT chunk_id, b, unnest(range(1, len(b) - 1)) AS i FROM toks)",
    "postings": "SELECT chunk_id, phrase, count(*) AS f FROM runs WHERE phrase IN"
                " (SELECT phrase FROM wanted) GROUP BY ALL",
    "dfs": "SELECT phrase, count(*) AS df FROM postings GROUP BY phrase",
    "st": "SELECT count(*) AS n, avg(len) AS av FROM lens",
    "scored": "SELECT key, chunk_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2"
              " / (f + 1.2 * (0.25 + 0.75 * len / av))) AS score FROM postings JOIN dfs USING (phrase)"
              " JOIN wanted USING (phrase) JOIN lens USING (chunk_id), st GROUP BY key, chunk_id",
}

ORACLES = {
    "boilerplate_keys": with_sources([], KEYED, "SELECT * FROM boiler"),
    "stripped_lines": with_sources(
        [], {**KEYED,
             "kept": "SELECT * FROM keyed k ANTI JOIN boiler b ON k.doc_key = b.doc_key AND"
                     " k.key = b.key WHERE NOT (k.doc_key IN (SELECT doc_key FROM boiler) AND"
                     " length(trim(k.text)) > 0 AND len(" + _TOK.format("trim(k.text)") + ") <= 3 AND"
                     " NOT regexp_matches(trim(k.text), '\\p{L}'))"},
        "SELECT doc_key, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars FROM kept"
        " GROUP BY doc_key"),
    "corpus_vocabulary": with_sources(
        [], {"lines": LINES},
        "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text),"
        " '[a-z][a-z\\-]*[a-z]|[a-z]')) AS word FROM lines) GROUP BY word"),
    "exact_duplicates":
        f"SELECT sha256({_KEY.format('text')}) AS digest, min(doc_id) AS first_doc, count(*) AS copies"
        " FROM documents GROUP BY ALL",
    "content_hash": with_sources(
        [], {"one": "SELECT source, doc_id // 1000 AS part, doc_id || ':' || sha256(coalesce(text, '')) AS h"
                    " FROM documents",
             "parts": "SELECT source, part, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM one GROUP BY ALL",
             "srcs": "SELECT source, sha256(string_agg(h, chr(10) ORDER BY part)) AS h FROM parts GROUP BY source",
             "buckets": "SELECT substr(sha256(source), 1, 3) AS b, sha256(string_agg(source || ':' || h, chr(10)"
                        " ORDER BY source || ':' || h)) AS h FROM srcs GROUP BY b"},
        "SELECT substr(sha256(string_agg(b || ':' || h, chr(10) ORDER BY b || ':' || h)), 1, 16) AS manifest_hash"
        " FROM buckets"),
    "graded_statements": with_sources(
        [], {"lines": NUMBERED},
        "SELECT doc_key, (['strong', 'conditional', 'weak'])[1 + (page + line_no) % 3] AS strength,"
        " (['very low', 'low', 'moderate', 'high'])[1 + (page + line_no) % 4] AS certainty,"
        " count(*) AS statements FROM lines GROUP BY ALL"),
    "line_shapes": with_sources(
        [], {"lines": "SELECT doc_key, trim(line, ' ') AS text FROM (" + NUMBERED + ")",
             "toks": "SELECT *, " + _TOK.format("text") + " AS tok FROM lines",
             "shaped": "SELECT *, len(tok) AS w, " + _DENSE.format("tok") + " AS dense FROM toks",
             "tabled": "SELECT *, w >= 3 AND (dense >= 0.4 OR regexp_matches(text, '" + _SHORT + "')) AS t FROM shaped"},
        "SELECT doc_key, count(*) AS lines, count(*) FILTER (WHERE t) AS table_like,"
        " count(*) FILTER (WHERE length(text) > 0 AND w <= 14 AND NOT regexp_matches(text, '[.;,]$')"
        " AND NOT regexp_matches(text, '" + T.CONTENTS + "') AND regexp_matches(text, '^[\\p{Lu}\\p{Nd}]')"
        " AND length(regexp_replace(text, '[^\\p{L}]', '', 'g')) >= 3 AND NOT t"
        " AND NOT regexp_matches(text, '" + T.REFERENCE + "')) AS heading_like,"
        " count(*) FILTER (WHERE dense >= 0.25) AS numeric_dense,"
        " count(*) FILTER (WHERE regexp_matches(text, '" + T.ROMAN + "')) AS roman,"
        " count(*) FILTER (WHERE regexp_matches(text, '" + T.OUTLINE + "')) AS outline,"
        " CAST(sum(w) AS BIGINT) AS words, count(DISTINCT " + _MASKED + ") AS line_keys FROM tabled GROUP BY doc_key"),
    "glyph_repair": with_sources(
        [], {"styled": "SELECT doc_id, regexp_replace(replace(text, 'e', '\u00bc'), '\\bthe\\b|\\bth\u00bc\\b',"
                       " 'xy', 'g') AS t FROM documents",
             "fixed": "SELECT doc_id, replace(t, '\u00bc', '=') AS t FROM styled"},
        "SELECT doc_id, length(t) AS chars, length(t) - length(replace(t, '=', '')) AS equals,"
        " len(string_split(t, 'xy')) - 1 AS folded FROM fixed"),
    "soft_breaks": with_sources([], BROKEN, "SELECT l AS \"left\", r AS \"right\", rule, glue FROM glued"),
    "repaired_breaks": with_sources(
        [], {**BROKEN,
             "saved": "SELECT doc_key, page, line_no, CAST(sum(length(seen) - length(l || glue || r)) AS BIGINT) AS n"
                      " FROM hits JOIN glued USING (l, r) GROUP BY ALL"},
        "SELECT doc_key, count(*) AS lines, CAST(sum(length(text) - coalesce(n, 0)) AS BIGINT) AS chars,"
        " CAST(0 AS BIGINT) AS unresolved FROM broken LEFT JOIN saved USING (doc_key, page, line_no) GROUP BY doc_key"),
    "evidence_keys": with_sources(
        [], {"phr": f"SELECT * FROM (VALUES {_key_phrases()}) v(key, channel, terms, phrase)",
             "docs": "SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower('Document ' || source), '[a-z0-9]+'), ' ')"
                     " || ' | ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS t FROM documents",
             "hits": "SELECT DISTINCT key, doc_id FROM (SELECT DISTINCT key, phrase FROM phr) JOIN docs"
                     " ON contains(t, ' ' || phrase || ' ')"},
        "SELECT key, channel, CAST(terms AS BIGINT) AS terms, least(12, count(doc_id)) AS ranked"
        " FROM (SELECT DISTINCT key, channel, terms FROM phr) LEFT JOIN hits USING (key) GROUP BY ALL"),
    "quoted_unchanged": "SELECT CAST(0 AS BIGINT) AS changed",
    "bm25_topk": with_sources(
        [], BM25,
        "SELECT key, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY key ORDER BY"
        " round(score, 9) DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 12"),
    "dense_topk": with_sources(
        [], {"long": "SELECT label, unnest(range(1, 65)) AS i, embedding FROM embeddings",
             "cent": "SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i,"
                     " avg(CAST(embedding[i] AS DOUBLE)) AS m FROM long GROUP BY ALL) GROUP BY label",
             "sims": "SELECT c.label, vec_id, round(list_cosine_similarity("
                     "CAST(embedding AS DOUBLE[]), c.c), 9) AS score FROM embeddings, cent c"},
        "SELECT label, vec_id, round(score, 5) AS score FROM sims QUALIFY row_number() OVER"
        " (PARTITION BY label ORDER BY score DESC, vec_id) <= 12"),
    "rank_fusion": with_sources(
        [], {"pairs": "SELECT l_suppkey, l_partkey, max(l_extendedprice) AS a, max(l_quantity) AS b"
                      " FROM lineitem GROUP BY ALL",
             "ranks": "SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY"
                      " a DESC, l_partkey) AS ra, row_number() OVER (PARTITION BY l_suppkey ORDER BY"
                      " b DESC, l_partkey) AS rb FROM pairs"},
        "SELECT l_suppkey, l_partkey, round(CASE WHEN ra <= 12 THEN 1.0 / (60 + ra) ELSE 0 END + CASE"
        " WHEN rb <= 12 THEN 1.0 / (60 + rb) ELSE 0 END, 5) AS score, CAST(ra <= 12 AS BIGINT) +"
        " CAST(rb <= 12 AS BIGINT) AS channels FROM ranks WHERE ra <= 12 OR rb <= 12"),
    "document_admission":
        "SELECT d AS decision, CAST(coalesce(sum(n), 0) AS BIGINT) AS pages FROM (VALUES ('admitted'),"
        " ('refused')) v(d) LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) s"
        " ON (d = 'admitted') = (n > 50) GROUP BY d",
    "turn_words":
        "SELECT role, count(*) AS turns, CAST(sum(len(" + _TOK.format("text") + ")) AS BIGINT) AS words"
        " FROM conversations GROUP BY role",
    "page_titles":
        "SELECT page_id, len(" + _TOK.format("t") + ") AS words, " + _KEY.format("t") + " AS title_key"
        " FROM (SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS t"
        " FROM pages)",
}
