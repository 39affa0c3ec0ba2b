"""Search, text and merge operators over documents, pages and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.functions import vectors
from codeloom.functions.keywords import STOP_WORDS, keywords
from codeloom.operators import chunking, formatting, keyed, merging, overlap, vector_search
from codeloom.plans.registry import query, spread_table, table, wide_ints
from codeloom.sources import file_profile, ignore_rules

# --------------------------------------------------------------------------- vectors


def query_vector(spark: SparkSession, sf: str, vec_id: int = 0) -> list[float]:
    row = table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").head()
    return list(row[0])


_COSINE = """
    list_dot_product(e.embedding::DOUBLE[], q.v::DOUBLE[])
    / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))
       * sqrt(list_dot_product(q.v::DOUBLE[], q.v::DOUBLE[])))"""


@query(
    f"""
    WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
    hits AS (SELECT e.vec_id, e.label, {_COSINE} AS s FROM embeddings e, q
             ORDER BY s DESC, vec_id LIMIT 24)
    SELECT vec_id, label::BIGINT AS label, round(s, 6) AS score FROM hits"""
)
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    hits = vector_search.cosine_topk(rows, query_vector(spark, sf), 24, "vec_id")
    full = vector_search.hydrate(hits, rows.select("vec_id", "label"), "vec_id")
    return wide_ints(full.select("vec_id", "label", F.round("score", 6).alias("score")))


@query(
    """
    WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
    s AS (SELECT label, vec_id,
            list_dot_product(embedding::DOUBLE[], v)
            / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))
               * sqrt(list_dot_product(v, v)) + 1e-10) AS s FROM embeddings, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rank FROM s)
    SELECT label::BIGINT AS label, vec_id, rank, round(s, 6) AS score FROM r WHERE rank <= 5"""
)
def vector_topk_per_label(spark: SparkSession, sf: str) -> DataFrame:
    hits = vector_search.cosine_topk_per_group(
        table(spark, sf, "embeddings"), query_vector(spark, sf), 5, "label", "vec_id"
    )
    return wide_ints(hits.select("label", "vec_id", "rank", F.round("score", 6).alias("score")))


@query(
    """
    WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v,
                 sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings)
    SELECT vec_id, round(norm, 6) AS norm, round(v[1] / norm, 6) AS first_value,
           round(list_dot_product(list_transform(v, lambda x: x / norm),
                                  list_transform(v, lambda x: x / norm)), 6) AS unit_length FROM n"""
)
def vector_normalise(spark: SparkSession, sf: str) -> DataFrame:
    unit = table(spark, sf, "embeddings").select(
        "vec_id",
        F.round(vectors.norm(F.col("embedding")), 6).alias("norm"),
        vectors.normalise(F.col("embedding")).alias("u"),
    )
    return unit.select(
        "vec_id",
        "norm",
        F.round(F.get("u", F.lit(0)), 6).alias("first_value"),
        F.round(vectors.dot(F.col("u"), F.col("u")), 6).alias("unit_length"),
    )


@query(
    f"""
    WITH a AS (SELECT e.vec_id, {_COSINE} AS s FROM embeddings e,
                 (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) q ORDER BY s DESC, 1 LIMIT 50),
    b AS (SELECT e.vec_id, {_COSINE} AS s FROM embeddings e,
                 (SELECT embedding AS v FROM embeddings WHERE vec_id = 1) q ORDER BY s DESC, 1 LIMIT 50)
    SELECT vec_id, round(max(s), 6) AS score
    FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY vec_id"""
)
def best_of_searches(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    found = [
        vector_search.cosine_topk(rows, query_vector(spark, sf, i), 50, "vec_id") for i in (0, 1)
    ]
    best = vector_search.best_of(*found, id_col="vec_id")
    return best.select("vec_id", F.round("score", 6).alias("score"))


# ----------------------------------------------------------------------- text and files


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of repositories: the source is the repository, the language a folder."""
    suffix = (
        F.when(F.col("lang") == "en", ".py")
        .when(F.col("lang") == "de", ".go")
        .when(F.col("lang") == "fr", ".md")
        .otherwise(".txt")
    )
    return spread_table(spark, sf, "documents").select(
        "doc_id",
        F.col("source").alias("repo_id"),
        F.concat(F.col("lang"), F.lit("/doc"), F.col("doc_id").cast("string"), suffix).alias("file_path"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.col("text").alias("content"),
    )


_SOURCES = """
    src AS (SELECT doc_id, source AS repo_id, lang || '/doc' || doc_id ||
              CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.go' WHEN 'fr' THEN '.md' ELSE '.txt' END
              AS file_path, strlen(text)::BIGINT AS size, text AS content FROM documents)"""

_LINES = r"""
    ln AS (SELECT doc_id, source AS repo_id, CASE WHEN text = '' THEN []
             ELSE string_split(regexp_replace(text, '\n\z', ''), chr(10)) END AS lines FROM documents)"""


def _windows_sql(name: str, size: int, step: int, extra: str = "") -> str:
    return rf"""
    {name}_b AS (SELECT doc_id, repo_id, lines, unnest(range(0, len(lines), {step})) AS b FROM ln),
    {name} AS (SELECT * FROM (SELECT doc_id, repo_id, b AS block, b + 1 AS start_line,
                 least(b + {size}, len(lines)) AS end_line,
                 array_to_string(lines[b + 1 : b + {size}], chr(10)) AS content FROM {name}_b)
               WHERE regexp_matches(content, '\S') {extra})"""


@query(
    f"""WITH {_LINES}, {_windows_sql('w', 32, 24)}
    SELECT doc_id, block, start_line, end_line, md5(content) AS digest FROM w"""
)
def chunk_lines(spark: SparkSession, sf: str) -> DataFrame:
    files = spread_table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    chunks = chunking.line_windows(files, 32, 8)
    return wide_ints(
        chunks.select("doc_id", "block", "start_line", "end_line", F.md5("content").alias("digest"))
    )


@query(
    f"""WITH {_SOURCES}
    SELECT repo_id, file_path, size,
           CASE regexp_extract(file_path, '(\\.[^.]+)$', 1)
             WHEN '.py' THEN 'python' WHEN '.go' THEN 'go' WHEN '.md' THEN 'markdown' END AS language
    FROM src WHERE size <= 4000 AND split_part(file_path, '/', 1) <> 'fr' AND file_path NOT LIKE '%.txt'"""
)
def file_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = file_profile.indexed_files(sources(spark, sf), max_bytes=4000, extra_skip_dirs=("fr",))
    return kept.select("repo_id", "file_path", "size", "language")


@query(
    f"""WITH {_SOURCES}
    SELECT repo_id, file_path FROM src WHERE NOT CASE
        WHEN regexp_matches(file_path, '^(.+/)?doc9[^/]*\\.md(/.*)?$') THEN true
        WHEN regexp_matches(file_path, '^de/.*$') THEN true
        WHEN regexp_matches(file_path, '^(.+/)?doc1[^/]*\\.txt(/.*)?$') THEN false
        WHEN regexp_matches(file_path, '^(.+/)?[^/]*\\.txt(/.*)?$') THEN true
        ELSE false END"""
)
def ignore_match(spark: SparkSession, sf: str) -> DataFrame:
    listing = sources(spark, sf).select("repo_id", "file_path")
    rule_file = listing.select("repo_id").distinct().select(
        "repo_id",
        F.lit(".gitignore").alias("file_path"),
        F.lit("# generated\n*.txt\n!doc1*.txt\n/de/\ndoc9*.md\n").alias("content"),
    )
    return ignore_rules.drop_ignored(listing, ignore_rules.ignore_rules(rule_file))


_BLANK = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        {c}, '"(?:[^"\\]|\\[^\n])*"', '""', 'g'), '''(?:[^''\\]|\\[^\n])*''', '''''', 'g'),
        '`(?:[^`\\]|\\[^\n])*`', '``', 'g'), '//[^\n]*', '', 'g'), '#[^\n]*', '', 'g'),
        '(?s)/\*.*?\*/', '', 'g')"""


@query(
    f"""SELECT page_id, length({_BLANK.format(c='html')}) AS code_chars,
               md5({_BLANK.format(c='html')}) AS digest FROM pages"""
)
def blank_code(spark: SparkSession, sf: str) -> DataFrame:
    code = spread_table(spark, sf, "pages").select("page_id", tx.blank_code(F.col("html")).alias("code"))
    return wide_ints(
        code.select("page_id", F.length("code").alias("code_chars"), F.md5("code").alias("digest"))
    )


_STOP_SQL = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))


@query(
    f"""
    WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9_]*')) AS word,
                 generate_subscripts(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9_]*'), 1) AS pos FROM documents),
    k AS (SELECT doc_id, lower(word) AS low, min(pos) AS pos, arg_min(word, pos) AS word FROM w
          WHERE length(word) > 2 AND lower(word) NOT IN ({_STOP_SQL}) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM k)
    SELECT d.doc_id, coalesce(string_agg(word, ' ' ORDER BY pos), '') AS keywords
    FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND n <= 20 GROUP BY d.doc_id"""
)
def keyword_extract(spark: SparkSession, sf: str) -> DataFrame:
    return spread_table(spark, sf, "documents").select(
        "doc_id", F.array_join(keywords(F.col("text")), " ").alias("keywords")
    )


@query(
    f"""WITH {_LINES}
    SELECT doc_id, md5(CASE WHEN len(lines) > 10 THEN array_to_string(list_concat(
        lines[1:5], ['... (' || (len(lines) - 10) || ' lines truncated) ...'], lines[-5:]), chr(10))
        ELSE text END) AS digest FROM ln JOIN documents USING (doc_id)"""
)
def elide_middle(spark: SparkSession, sf: str) -> DataFrame:
    return spread_table(spark, sf, "documents").select(
        "doc_id", F.md5(tx.elide_middle(F.col("text"), 10)).alias("digest")
    )


@query(
    f"""WITH {_SOURCES}, {_LINES}, {_windows_sql('w', 32, 24)},
    roots AS (SELECT DISTINCT source AS repo_id, CASE WHEN source < 'src2' THEN '/repos/' || source || '/' END
              AS root FROM documents)
    SELECT doc_id, block, CASE WHEN root IS NULL THEN file_path ELSE '/repos/' || repo_id || '/' || file_path END
             AS abs_path,
           md5('title: ' || file_path || ':L' || start_line || '-' || end_line || ' | text: ' || w.content)
             AS prompt_digest
    FROM w JOIN src USING (doc_id, repo_id) JOIN roots USING (repo_id)"""
)
def document_prompts(spark: SparkSession, sf: str) -> DataFrame:
    files = sources(spark, sf)
    roots = files.select("repo_id").distinct().select(
        "repo_id",
        F.when(F.col("repo_id") < "src2", F.concat(F.lit("/repos/"), "repo_id", F.lit("/"))).alias("root"),
    )
    chunks = chunking.line_windows(files, 32, 8).join(roots, "repo_id")
    title = tx.document_title(
        F.col("file_path"), F.lit(None).cast("string"), F.col("start_line"), F.col("end_line")
    )
    return wide_ints(
        chunks.select(
            "doc_id",
            "block",
            tx.absolute_path(F.col("file_path"), F.col("root")).alias("abs_path"),
            F.md5(tx.document_prompt(F.col("content"), title)).alias("prompt_digest"),
        )
    )


# ---------------------------------------------------------------- line ranges and merging


def spans(spark: SparkSession, sf: str, size: int, overlap_lines: int) -> DataFrame:
    files = spread_table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("repo_id"), F.col("text").alias("content")
    )
    return chunking.line_windows(files, size, overlap_lines)


@query(
    f"""WITH {_LINES}, {_windows_sql('c', 32, 24)}, {_windows_sql('m', 7, 7)}
    SELECT c.doc_id, c.block AS chunk, m.block AS method FROM c JOIN m
    ON c.doc_id = m.doc_id AND m.end_line >= c.start_line AND m.start_line <= c.end_line"""
)
def overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    chunks = spans(spark, sf, 32, 8).select("doc_id", F.col("block").alias("chunk"), "start_line", "end_line")
    methods = spans(spark, sf, 7, 0).select(
        "doc_id",
        F.col("block").alias("method"),
        F.col("start_line").alias("line_start"),
        F.col("end_line").alias("line_end"),
    )
    pairs = overlap.overlap_join(chunks, methods, ["doc_id"])
    return wide_ints(pairs.select("doc_id", "chunk", "method"))


_E_SHARE = "round((length(content) - length(replace(content, 'e', '')))::DOUBLE / length(content), 6)"


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of six lines that mention 'que' or 'the', scored by their share of the letter e."""
    rows = spans(spark, sf, 6, 2).where(F.col("content").rlike("que|the"))
    share = tx.occurrences(F.col("content"), "e").cast("double") / F.length("content")
    return rows.select(
        "doc_id",
        F.col("block").cast("string").alias("chunk_id"),
        "start_line",
        "end_line",
        F.round(share, 6).alias("score"),
        F.col("block").alias("ordinal"),
    )


def _merged_sql(cap: int) -> str:
    hits = _windows_sql("w", 6, 4, "AND regexp_matches(content, 'que|the')")
    return f"""RECURSIVE {_LINES}, {hits},
    h AS (SELECT doc_id, block, start_line AS s, end_line AS e, {_E_SHARE} AS score,
            row_number() OVER (PARTITION BY doc_id ORDER BY start_line, block) AS n FROM w),
    walk AS (SELECT doc_id, n, 1 AS grp, s AS cs, e AS ce FROM h WHERE n = 1
      UNION ALL
      SELECT h.doc_id, h.n, k.grp + (NOT t.j)::INT, CASE WHEN t.j THEN least(k.cs, h.s) ELSE h.s END,
             CASE WHEN t.j THEN greatest(k.ce, h.e) ELSE h.e END
      FROM walk k JOIN h ON h.doc_id = k.doc_id AND h.n = k.n + 1,
           LATERAL (SELECT h.s <= k.ce + 1 AND h.e - k.cs + 1 <= {cap} AS j) t),
    merged AS (SELECT doc_id, min(s) AS start_line, max(e) AS end_line, max(score) AS score,
                 min(block) AS ordinal, string_agg(block::VARCHAR, '+' ORDER BY n) AS chunk_id,
                 count(*) AS parts FROM walk JOIN h USING (doc_id, n) GROUP BY doc_id, grp)"""


@query(
    f"""WITH {_merged_sql(12)}
    SELECT doc_id, start_line, end_line, score, chunk_id FROM merged"""
)
def interval_merge(spark: SparkSession, sf: str) -> DataFrame:
    blocks = merging.merge_neighbours(_hits(spark, sf), 12, ("doc_id",))
    return wide_ints(
        blocks.select(
            "doc_id", "start_line", "end_line", "score", F.array_join("part_ids", "+").alias("chunk_id")
        )
    )


def _two_sets(spark: SparkSession, sf: str) -> DataFrame:
    share = F.round(tx.occurrences(F.col("content"), "e").cast("double") / F.length("content"), 6)
    small = spans(spark, sf, 6, 2).withColumn("set_id", F.lit(1))
    large = spans(spark, sf, 10, 5).withColumn("set_id", F.lit(2))
    return small.unionByName(large).select(
        "doc_id", "set_id", "block", "start_line", "end_line", share.alias("score"),
        (F.col("set_id") * 1000000 + F.col("block")).alias("ordinal"),
    )


@query(
    f"""WITH {_LINES}, {_windows_sql('a', 6, 4)}, {_windows_sql('b', 10, 5)},
    r AS (SELECT doc_id, 1 AS set_id, block, start_line, end_line, {_E_SHARE} AS score,
            1000000 + block AS ordinal FROM a
          UNION ALL SELECT doc_id, 2, block, start_line, end_line, {_E_SHARE}, 2000000 + block FROM b)
    SELECT doc_id, set_id::BIGINT AS set_id, block, start_line, end_line FROM r x WHERE NOT EXISTS (
      SELECT 1 FROM r y WHERE y.doc_id = x.doc_id AND y.start_line <= x.start_line AND y.end_line >= x.end_line
        AND (y.end_line - y.start_line > x.end_line - x.start_line
             OR (y.end_line - y.start_line = x.end_line - x.start_line
                 AND (y.score > x.score OR (y.score = x.score AND y.ordinal < x.ordinal)))))"""
)
def containment_drop(spark: SparkSession, sf: str) -> DataFrame:
    kept = merging.drop_covered(_two_sets(spark, sf), ("doc_id",))
    return wide_ints(kept.select("doc_id", "set_id", "block", "start_line", "end_line"))


@query(
    f"""WITH {_LINES}, {_windows_sql('a', 6, 4)}, {_windows_sql('b', 10, 5)},
    r AS (SELECT doc_id, 1 AS set_id, block, {_E_SHARE} AS score, false AS graph_only FROM a
          UNION ALL SELECT doc_id, 2, block, 0.5 * {_E_SHARE}, true FROM b),
    n AS (SELECT *, row_number() OVER (PARTITION BY graph_only ORDER BY score DESC, doc_id, block) AS rk,
            count(*) OVER () AS total, count(*) FILTER (graph_only) OVER () AS graphs FROM r)
    SELECT doc_id, block, graph_only, round(score, 6) AS score FROM n
    WHERE rk <= CASE WHEN total <= 50 THEN total WHEN graph_only THEN least(graphs, 15)
                ELSE 50 - least(graphs, 15) END"""
)
def quota_topk(spark: SparkSession, sf: str) -> DataFrame:
    both = _two_sets(spark, sf).withColumn("graph_only", F.col("set_id") == 2)
    scored = both.withColumn(
        "score", F.when(F.col("graph_only"), F.col("score") * 0.5).otherwise(F.col("score"))
    ).withColumn("ordinal", F.struct("doc_id", "block"))
    best = merging.quota_topk(scored, 50)
    return wide_ints(best.select("doc_id", "block", "graph_only", F.round("score", 6).alias("score")))


@query(
    f"""WITH {_merged_sql(12)},
    p AS (SELECT doc_id, min(s) AS start_line, count(*) AS parts, count(*) FILTER (score >= 0.1) AS g
          FROM walk JOIN h USING (doc_id, n) GROUP BY doc_id, grp)
    SELECT doc_id, start_line, parts, g = parts AS graph_only,
           CASE WHEN g = parts THEN 'graph' WHEN g > 0 THEN 'embedding+graph' ELSE 'embedding' END AS source
    FROM p"""
)
def block_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Windows rich in the letter e count as found by the graph."""
    hits = _hits(spark, sf).withColumn("chunk_id", F.concat_ws(":", "doc_id", "chunk_id"))
    from_graph = hits.where(F.col("score") >= 0.1).select("chunk_id")
    blocks = merging.merge_neighbours(hits, 12, ("doc_id",))
    labelled = merging.found_by(blocks, from_graph)
    return wide_ints(
        labelled.select("doc_id", "start_line", F.size("part_ids").alias("parts"), "graph_only", "source")
    )


@query(
    r"""
    WITH r AS (SELECT md5(text) AS id, n_chars::DOUBLE / 20000 AS score, doc_id,
                 row_number() OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id) AS n FROM documents)
    SELECT id, round(score, 6) AS score, doc_id FROM r WHERE n = 1"""
)
def dedup_best(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(
        F.md5("text").alias("id"), (F.col("n_chars").cast("double") / 20000).alias("score"), "doc_id"
    )
    best = keyed.keep_best(rows, ["id"], "score", "doc_id")
    return best.select("id", F.round("score", 6).alias("score"), "doc_id")


_TOP_DOCS = """
    WITH t AS (SELECT doc_id, source, text, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50),
    r AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank,
            CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, '\\n\\z', ''), chr(10)) END
              AS lines FROM t),
    k AS (SELECT rank, '/repos/' || source || '/' || doc_id || '#L1-' || len(lines) AS header,
            array_to_string(list_transform(lines, lambda x, i: i || ': ' || CASE WHEN length(x) > 1000
              THEN substr(x, 1, 1000) || ' [truncated — use Read tool for full content]' ELSE x END),
              chr(10)) AS body FROM r),
    z AS (SELECT rank, header, header || chr(10) || body AS block FROM k),
    s AS (SELECT *, sum(strlen(block)) OVER (ORDER BY rank) + 2 * (rank - 1) AS total FROM z),
    v AS (SELECT *, max(total) OVER (ORDER BY rank) <= 80000 AS shown FROM s)"""


def _top_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 longest documents as a ranked result (the top-k report the formatter serves)."""
    best = table(spark, sf, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(50)
    ranked = merging.with_ordinal(
        best.withColumn("score", F.col("n_chars").cast("double")), "doc_id"
    )
    return ranked.select(
        F.col("ordinal").alias("rank"),
        F.concat(F.lit("/repos/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        F.lit(1).alias("start_line"),
        F.size(tx.split_lines(F.col("text"))).alias("end_line"),
        F.col("text").alias("content"),
    )


@query(
    _TOP_DOCS.replace("\\\\", "\\")
    + " SELECT rank, header, md5(block) AS digest, total::BIGINT AS total_bytes, shown FROM v"
)
def byte_budget_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rendered = formatting.render_blocks(_top_documents(spark, sf))
    return wide_ints(
        rendered.select("rank", "header", F.md5("block").alias("digest"), "total_bytes", "shown")
    )


@query(
    _TOP_DOCS.replace("\\\\", "\\")
    + """,
    g AS (SELECT coalesce(string_agg(block, chr(10) || chr(10) ORDER BY rank) FILTER (shown), '') AS text,
            count(*) FILTER (shown) AS n, count(*) AS total,
            string_agg(header, chr(10) ORDER BY rank) FILTER (NOT shown) AS hidden FROM v)
    SELECT md5(text || CASE WHEN n < total THEN chr(10) || chr(10) || '[Showing ' || n || '/' || total
      || ' results. Remaining (use Read tool):' || chr(10) || hidden || ']' ELSE '' END) AS digest FROM g"""
)
def byte_budget_output(spark: SparkSession, sf: str) -> DataFrame:
    rendered = formatting.render_blocks(_top_documents(spark, sf))
    return formatting.format_results(rendered).select(F.md5("output").alias("digest"))
