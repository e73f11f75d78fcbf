"""Pages of text lines to citable chunks.

A line is (doc_key, page, line_no, text) with optional typography (size, bold, font). A
document may hold most of all pages: nothing here groups by document without adding up
per-page results first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ventide import config as C
from ventide.functions import textfn as T
from ventide.operators.scan import Running, scan
from ventide.session import materialize

PAGES_PER_CHUNK = 64


def admit(documents: DataFrame, registry: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Documents on the admission list, and the refused rest."""
    known = registry.select(key).distinct()
    return documents.join(known, key, "left_semi"), documents.join(known, key, "left_anti")


def page_lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """One row per line of every page."""
    kept = [c for c in pages.columns if c != text]
    return pages.select(
        *kept, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line_no", "text"))


# ------------------------------------------------------------ soft breaks
def vocabulary(lines: DataFrame) -> DataFrame:
    """Word counts without the fragments next to a break."""
    masked = F.regexp_replace(
        "text", f"[A-Za-z]*{T.SOFT_BREAK}\\s*[A-Za-z]*", " ")
    word = F.explode(F.regexp_extract_all(
        F.lower(masked), F.lit(r"[a-z][a-z\-]*[a-z]|[a-z]"), F.lit(0)))
    return lines.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def break_pairs(lines: DataFrame) -> DataFrame:
    """Distinct (left, right) halves around a break."""
    pattern = f"([A-Za-z]+){T.SOFT_BREAK}\\s*([A-Za-z]+)"
    left = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    right = F.regexp_extract_all("text", F.lit(pattern), F.lit(2))
    zipped = F.explode(F.arrays_zip(left.alias("left"), right.alias("right"))).alias("_p")
    return lines.where(F.col("text").contains(T.SOFT_BREAK)).select(zipped).select(
        "_p.left", "_p.right").distinct()


def resolve_breaks(pairs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Join, hyphenate or keep: four rules in order, by what the corpus itself attests.

    The vocabulary grows with the corpus, so it is joined, never shipped whole.
    """
    candidates = pairs.select(
        "left", "right",
        F.explode(F.array(
            F.struct(F.lit("joined").alias("form"), F.lower(F.concat("left", "right")).alias("word")),
            F.struct(F.lit("hyphen").alias("form"),
                     F.lower(F.concat_ws("-", "left", "right")).alias("word")),
            F.struct(F.lit("a").alias("form"), F.lower("left").alias("word")),
            F.struct(F.lit("b").alias("form"), F.lower("right").alias("word")),
        )).alias("_c"),
    ).select("left", "right", "_c.form", "_c.word")
    seen = candidates.join(vocab, "word", "left").groupBy("left", "right").agg(*[
        F.max(F.when((F.col("form") == f) & F.col("n").isNotNull(), 1).otherwise(0)).alias(f)
        for f in ("joined", "hyphen", "a", "b")
    ])
    rule = (F.when(F.col("joined") == 1, "joined_attested")
            .when(F.col("hyphen") == 1, "hyphen_attested")
            .when((F.col("a") == 1) & (F.col("b") == 1), "both_halves_are_words")
            .otherwise("default_join"))
    return seen.select("left", "right", rule.alias("rule")).withColumn(
        "glue", F.when(F.col("rule").isin("hyphen_attested", "both_halves_are_words"), "-")
        .otherwise(""))


def repair_breaks(lines: DataFrame, resolved: DataFrame, keys: list[str]) -> DataFrame:
    """Apply the resolved glue to every line; a break without two halves becomes a hyphen.

    Only the distinct pairs of a line travel: they are joined with their glue and come back as
    one small map per line, by which the line is rebuilt in place.
    """
    halves = f"([A-Za-z]+){T.SOFT_BREAK}\\s*([A-Za-z]+)"
    broken = lines.where(F.col("text").contains(T.SOFT_BREAK))
    whole = lines.where(~F.col("text").contains(T.SOFT_BREAK) | F.col("text").isNull())
    found = lambda group: F.regexp_extract_all("text", F.lit(halves), F.lit(group))
    pairs = broken.select(*keys, F.explode(F.array_distinct(F.arrays_zip(
        found(0).alias("seen"), found(1).alias("left"), found(2).alias("right")))).alias("_p"))
    glued = pairs.select(*keys, "_p.*").join(resolved.select("left", "right", "glue"), ["left", "right"], "left")
    maps = glued.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(
        "seen", F.concat("left", F.coalesce("glue", F.lit("")), "right").alias("fixed")))).alias("_fixes"))
    # The text between the pairs, and the pairs, take turns.
    between = F.split("text", halves, -1)
    mended = F.array_join(F.zip_with(between, found(0), lambda text, pair: F.concat(
        F.replace(text, F.lit(T.SOFT_BREAK), F.lit("-")),
        F.coalesce(F.try_element_at("_fixes", pair), F.lit("")))), "")
    rest = [c for c in lines.columns if c != "text"]
    out = broken.join(maps, keys, "left").select(*rest, mended.alias("text"))
    return whole.select(*rest, "text").unionByName(out)


# ------------------------------------------------------------ boilerplate
def boilerplate_keys(lines: DataFrame) -> DataFrame:
    """Line keys on at least a quarter (and three) of a document's pages, four pages or more.

    Pages are counted per (document, key) after dropping repeats inside a page.
    """
    keyed = lines.select("doc_key", "page", T.line_key(T.mask_digits(F.col("text"))).alias("key"))
    pages = materialize(lines.select("doc_key", "page").distinct().groupBy("doc_key").agg(
        F.count(F.lit(1)).alias("pages")))
    per_key = keyed.distinct().groupBy("doc_key", "key").agg(F.count(F.lit(1)).alias("on_pages"))
    cut = F.greatest(F.lit(3), F.floor(F.col("pages") * 0.25))
    return per_key.join(pages, "doc_key").where(
        (F.col("pages") >= 4) & (F.col("on_pages") >= cut) & F.length("key").between(1, 90)
    ).select("doc_key", "key", "on_pages", "pages")


def strip_boilerplate(lines: DataFrame) -> DataFrame:
    """Lines without running headers, footers and bare page numbers.

    Keys and documents are few beside the lines. Each list is written once, so Spark knows its size
    before it chooses a join, and a document's lines are not gathered for it.
    """
    stripped = F.trim("text")
    bare = (F.length(stripped) > 0) & (T.word_count(stripped) <= 3) & ~stripped.rlike(r"\p{L}")
    lines = materialize(lines)
    found = materialize(boilerplate_keys(lines).select("doc_key", "key"))
    affected = materialize(found.select("doc_key").distinct().withColumn("_affected", F.lit(True)))
    keyed = lines.withColumn("key", T.line_key(T.mask_digits(F.col("text"))))
    kept = keyed.join(found, ["doc_key", "key"], "left_anti").join(affected, "doc_key", "left")
    return kept.where(F.col("_affected").isNull() | ~bare).select(*lines.columns)


# ------------------------------------------------------------ headings
def body_style(lines: DataFrame) -> DataFrame:
    """Most frequent size and font of body-length lines per document, by characters."""
    body = lines.where(F.length(F.trim("text")) >= 20)
    by = lambda c: body.groupBy("doc_key", F.col(c).alias("v")).agg(
        F.sum(F.length("text")).alias("chars")).groupBy("doc_key").agg(
        F.max_by("v", F.struct("chars", "v")).alias(f"base_{c}"))
    return by("size").join(by("font"), "doc_key")


def tag_headings(lines: DataFrame) -> DataFrame:
    """Add `level`: 0 for the largest headings of a document, 1 for others, null for text.

    Protocols are read by their roman numerals, other documents by shape and typography.
    """
    lines = materialize(lines)
    styled = lines.join(materialize(body_style(lines)), "doc_key", "left")
    text = F.trim("text")
    big = F.col("size") > F.col("base_size") + 0.4
    bold = F.col("bold") & (F.col("size") >= F.col("base_size") - 0.1)
    other = F.col("font") != F.col("base_font")
    typographic = T.heading_like(text) & F.coalesce(big | bold | other, F.lit(False))
    protocol = F.col("role") == "protocol"
    head = F.when(protocol, text.rlike(T.ROMAN)).otherwise(typographic)
    rank = F.when(protocol, 99.0).otherwise(F.round(F.col("size") + F.when(big, 1.0).otherwise(0.0), 1))
    ranked = styled.withColumn("_rank", F.when(head, rank))
    ranked = materialize(ranked.select(*lines.columns, "_rank"))
    top = materialize(ranked.groupBy("doc_key").agg(F.max("_rank").alias("_top")))
    level = F.when(F.col("_rank").isNotNull(), F.when(F.col("_rank") >= F.col("_top"), 0).otherwise(1))
    return ranked.join(top, "doc_key", "left").withColumn("level", level).select(
        *lines.columns, "level")


def heading_paths(tagged: DataFrame) -> DataFrame:
    """Add `heading_path` (section, subsection) in force at every line.

    The path is carried across pages; a section clears the subsection below it.
    """
    at = F.struct("page", "line_no")
    head = F.struct(at.alias("at"), F.trim("text").alias("text"))
    carried = scan(
        tagged, ["doc_key"], "page",
        {"_h0": Running("last", F.when(F.col("level") == 0, head)),
         "_h1": Running("last", F.when(F.col("level") == 1, head)),
         "_first1": Running("min", F.when(F.col("level") == 1, head))},
        tie=["line_no"], chunk=F.floor(F.col("page") / PAGES_PER_CHUNK),
    )
    # Before any section the first subsection heads the path.
    section = F.coalesce("_h0", "_first1")
    below = F.when(F.col("_h1.at") > section["at"], F.col("_h1.text"))
    path = F.array_compact(F.array(section["text"], below))
    return carried.withColumn("heading_path", path).drop("_h0", "_h1", "_first1")


# ------------------------------------------------------------ chunks
def _greedy_parts(counts: Column) -> Column:
    """Part number per line: a part closes once it holds the maximum number of words."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("part"), F.lit(0).alias("total"))

    def put(state: Column, n: Column) -> Column:
        total = state["total"] + n
        full = total >= C.CHUNK_MAX_WORDS
        return F.struct(
            F.concat(state["out"], F.array(state["part"])).alias("out"),
            F.when(full, state["part"] + 1).otherwise(state["part"]).alias("part"),
            F.when(full, 0).otherwise(total).alias("total"))

    return F.aggregate(counts, start, put)["out"]


def chunk_lines(lines: DataFrame) -> DataFrame:
    """Chunks inside a page: headings and outline items open one, the word limit closes it.

    `lines` carries doc_key, role, page, line_no, text, level and heading_path. All groups
    are single pages.
    """
    text = F.trim("text")
    filled = lines.where(F.length(text) > 0)
    order = Window.partitionBy("doc_key", "page").orderBy("line_no")
    opens = F.col("level").isNotNull() | (
        (F.col("role") == "protocol") & text.rlike(T.OUTLINE))
    numbered = filled.withColumn("_segment", F.sum(opens.cast("int")).over(order)).where(
        F.col("level").isNull())
    page = numbered.groupBy("doc_key", "role", "page", "_segment").agg(
        F.min("line_no").alias("_first"),
        F.array_sort(F.collect_list(F.struct(
            "line_no", text.alias("text"), T.word_count(text).alias("n"), "heading_path"))
        ).alias("_lines"),
        F.max((F.col("role") == "protocol").cast("int")).alias("_protocol"),
    )
    parts = page.withColumn("_parts", _greedy_parts(F.transform("_lines", lambda s: s["n"])))
    line = F.explode(F.arrays_zip("_lines", "_parts")).alias("_l")
    grouped = parts.select("doc_key", "role", "page", "_segment", line).groupBy(
        "doc_key", "role", "page", "_segment", F.col("_l._parts").alias("_part")
    ).agg(
        F.min("_l._lines.line_no").alias("first_line"),
        F.min_by("_l._lines.heading_path", "_l._lines.line_no").alias("heading_path"),
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct(
                F.col("_l._lines.line_no").alias("at"), F.col("_l._lines.text").alias("t")))),
            lambda s: s["t"]), " ").alias("text"),
    )
    squeezed = grouped.withColumn("text", T.squeeze(F.col("text")))
    dots = F.size(F.split("text", r"\.\.\.", -1)) - 1
    words = T.word_count(F.col("text"))
    kind = F.when(F.col("role") == "protocol", "recommendation").when(
        T.numeric_share(F.col("text")) >= 0.25, "table").otherwise("prose")
    return squeezed.where((words >= C.CHUNK_MIN_WORDS) & (dots < 3)).select(
        "doc_key", "page", "first_line", "heading_path", kind.alias("kind"),
        F.lit(None).cast("string").alias("strength"),
        F.lit(None).cast("string").alias("certainty"), "text", words.alias("words"),
    )


def graded_statements(lines: DataFrame) -> DataFrame:
    """Graded recommendations in guideline pages, once each, under their deepest heading."""
    pages = lines.where(F.col("role") == "guideline").groupBy("doc_key", "page").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), " "
        ).alias("_text"),
        F.max_by("heading_path", F.struct(F.size("heading_path"), -F.col("line_no")))
        .alias("heading_path"),
        F.min("line_no").alias("first_line"),
    )
    hit = F.explode(F.regexp_extract_all(T.squeeze(F.col("_text")), F.lit(T.GRADED), F.lit(0)))
    found = pages.select("doc_key", "page", "first_line", "heading_path", hit.alias("text"))
    found = found.withColumn("text", F.trim("text")).where(T.word_count(F.col("text")) >= 6)
    best = found.groupBy("doc_key", T.statement_key(F.col("text")).alias("_key")).agg(
        F.min_by(F.struct("page", "first_line", "heading_path", "text"),
                 F.struct(-F.size("heading_path"), "page", "first_line")).alias("_b"))
    return best.select(
        "doc_key", "_b.*",
    ).select(
        "doc_key", "page", "first_line", "heading_path", F.lit("recommendation").alias("kind"),
        F.lower(F.regexp_extract("text", T.GRADED, 3)).alias("strength"),
        F.regexp_replace(F.lower(F.regexp_extract("text", T.GRADED, 4)), r"\s+", " ")
        .alias("certainty"),
        "text", T.word_count(F.col("text")).alias("words"),
    )


def drop_duplicates(chunks: DataFrame) -> DataFrame:
    """First chunk per document and text key. A minimum, so copies collapse before the shuffle."""
    row = F.struct(*chunks.columns)
    first = F.min_by(row, F.struct("page", "first_line", "kind"))
    return chunks.groupBy("doc_key", T.statement_key(F.col("text")).alias("_key")).agg(
        first.alias("_row")).select("_row.*")


def number_chunks(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """Add chunk_id, title and citation from the registry (doc_key, title, cite)."""
    counted = scan(
        chunks, ["doc_key"], "page",
        {"_n": Running("sum", F.lit(1).cast("long"), strict=True)}, tie=["first_line", "text"],
        chunk=F.floor(F.col("page") / PAGES_PER_CHUNK),
    ).join(registry.select("doc_key", F.col("title").alias("doc_title"), "cite"), "doc_key")
    path = F.array_join("heading_path", " > ")
    return counted.select(
        F.format_string("%s:p%03d:c%04d", "doc_key", "page", F.coalesce("_n", F.lit(0)))
        .alias("chunk_id"),
        "doc_key", "page", "heading_path",
        F.when(F.size("heading_path") > 0, path).otherwise(F.col("doc_title")).alias("title"),
        "kind", "strength", "certainty",
        F.format_string("%s, p.%d", "cite", "page").alias("citation"), "text", "words",
    )


def corpus_report(chunks: DataFrame) -> DataFrame:
    """Chunks, words and median words per document and kind."""
    return chunks.groupBy("doc_key", "kind").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("words").alias("words"),
        F.median("words").alias("median_words"))


def manifest_hash(hashes: DataFrame, key: str = "doc_key", digest: str = "sha256") -> DataFrame:
    """One hash over all hashes: those of each bucket, named by the first three digits of the key's
    hash, make one, and the 4096 buckets at most make the whole. Order is by key and digest, so
    that every hash counts and none meets more than its bucket in one task."""
    line = F.concat_ws(":", key, digest)
    bucket = F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 3)
    lower = hashes.groupBy(bucket.alias("_bucket")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("_hash"))
    whole = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "_bucket", "_hash"))), "\n")
    return lower.agg(F.substring(F.sha2(whole, 256), 1, 16).alias("manifest_hash"))


def source_hashes(pages: DataFrame, source: str, page: str, text: str) -> DataFrame:
    """One digest per source over the digests of all its pages. A source may hold most pages: they
    are first put together by their page number's thousand, in order."""
    one = F.concat_ws(":", F.col(page).cast("string"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    part = F.floor(F.col(page) / 1000)
    lower = pages.groupBy(F.col(source).alias("doc_key"), part.alias("_part")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(one)), "\n"), 256).alias("_hash"))
    return lower.groupBy("doc_key").agg(F.sha2(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_part", "_hash"))), lambda p: p["_hash"]), "\n"), 256).alias("sha256"))


def quoted_unchanged(passages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Passages whose text is not byte for byte the chunk they cite."""
    return passages.join(chunks.select("chunk_id", "text"), ["chunk_id", "text"], "left_anti")

