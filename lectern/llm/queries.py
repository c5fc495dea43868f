"""Registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cluster import approx_tokens
from . import languages, mixing, neighbours, packing, pair_defects, scan_repair, site_lines, splitting
from .tables import settings, table


def _profiles(spark: SparkSession, sf_dir: str):
    return languages.train_profiles(table(spark, sf_dir, "documents"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.found_lines(table(spark, sf_dir, "pages"), table(spark, sf_dir, "parsed_documents"))


def p1_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.site_templates(table(spark, sf_dir, "parsed_documents")).select("source", "template", "documents", "wordings", F.round("fixed", 6).alias("fixed"))


def p1_clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.without_site_lines(table(spark, sf_dir, "parsed_documents")).select("doc_id", "text", F.col("removed").cast("bigint").alias("removed"))


def p1_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source, how many lines go with templates on: those of site wordings, and those that only a template covers."""
    parsed = table(spark, sf_dir, "parsed_documents")
    clean = site_lines.without_site_lines(parsed, templates=True)
    joined = clean.join(parsed.select("doc_id", "source"), "doc_id")
    return joined.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("removed") - F.col("by_template")).alias("site_lines"), F.sum("by_template").alias("by_template_only"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = settings(spark, sf_dir)
    return neighbours.close_pairs(table(spark, sf_dir, "vectors"), int(s["retrieval.k"]), dim=int(s["embedding.dimensions"]))


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = settings(spark, sf_dir)
    lists = neighbours.nearest(table(spark, sf_dir, "vectors"), int(s["retrieval.k"]), dim=int(s["embedding.dimensions"]))
    return lists.select(F.col("id").alias("chunk_id"), "neighbour", F.round("cosine", 4).alias("cosine"), "place")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = settings(spark, sf_dir)
    return splitting.split_oversized(
        table(spark, sf_dir, "chunks"), table(spark, sf_dir, "parsed_documents"), int(s["chunking.maxTokens"]), int(s["chunking.overlapTokens"])
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_pieces(spark, sf_dir).filter(F.col("piece_no") == 0).select("chunk_id")


def p3_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every set of pieces must fulfil: the item's text whole, the limit and the overlap kept, the offsets right."""
    s = settings(spark, sf_dir)
    whole = splitting.rejoined(p3_pieces(spark, sf_dir), table(spark, sf_dir, "parsed_documents"))
    limit, overlap = int(s["chunking.maxTokens"]), int(s["chunking.overlapTokens"])
    return whole.select("chunk_id", "solid", (F.col("most_tokens") <= limit).alias("within_limit"), (F.col("most_shared") <= overlap).alias("within_overlap"), "misplaced")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_defects.defective_pairs(table(spark, sf_dir, "review_items"), table(spark, sf_dir, "questions"), _profiles(spark, sf_dir))


def p4_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, profiles = table(spark, sf_dir, "review_items"), _profiles(spark, sf_dir)
    tagged = pair_defects.tag_pairs(pair_defects.distinct_items(rows), profiles, pair_defects.fit_sample(rows, profiles))
    return tagged.withColumnRenamed("id", "answer_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_repair.noisy_lines(table(spark, sf_dir, "pages"), table(spark, sf_dir, "parsed_documents"))


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_repair.repaired_documents(table(spark, sf_dir, "pages"), table(spark, sf_dir, "parsed_documents"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", approx_tokens(F.col("text")).alias("tokens"))


def _capacity(spark: SparkSession, sf_dir: str) -> int:
    return int(settings(spark, sf_dir)["generation.contextBudgetTokens"])


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_items(_sized(spark, sf_dir), _capacity(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_containers(spark, sf_dir).filter((F.col("pieces") > 1) & (F.col("piece_no") == 0)).select("doc_id")


def p6_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every packing must fulfil: each item whole, in as many pieces as it needs, and no container over its capacity."""
    placed, capacity = p6_containers(spark, sf_dir), _capacity(spark, sf_dir)
    over = placed.groupBy("container").agg(F.sum("tokens").alias("t")).filter(F.col("t") > capacity).select("container", F.lit(1).alias("over"))
    joined = placed.join(over, "container", "left")
    return joined.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"), F.count("over").alias("overfull"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.container_report(p6_containers(spark, sf_dir), _capacity(spark, sf_dir))


def p6_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction data: question and answer count against the capacity, only the answer bears loss, eight pairs at most."""
    items = table(spark, sf_dir, "review_items").dropDuplicates(["answer_id"])
    asked, given = approx_tokens(F.coalesce("question", F.lit(""))), approx_tokens(F.coalesce("given", F.lit("")))
    sized = items.select("answer_id", (asked + given).alias("tokens"), given.alias("loss"))
    return packing.pack_items(sized, 512, id_col="answer_id", loss_col="loss", max_segments=8, max_loss=384)


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[1]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_report(spark, sf_dir).filter("short").select("source")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[0].orderBy("finish")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    detected = languages.detect_languages(table(spark, sf_dir, "documents"), _profiles(spark, sf_dir))
    return languages.mislabelled(detected).select("doc_id", "found_lang")


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    detected = languages.detect_languages(table(spark, sf_dir, "documents"), _profiles(spark, sf_dir))
    return detected.select("doc_id", "label", "found_lang", F.round("confidence", 6).alias("confidence"), "sentences", "held")


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.language_passages(table(spark, sf_dir, "documents"), _profiles(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_templates, p1_clean_texts, p1_template_lines, p2_found, p2_neighbours, p3_found, p3_pieces, p3_rejoined, p4_found, p4_tags, p5_found, p5_repaired,
        p6_found, p6_containers, p6_totals, p6_report, p6_instructions, p7_found, p7_mix, p7_report, p8_found, p8_documents, p8_passages,
    )
}

_UNITS = "(length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]+', '', 'g')))"
_TOKENS = "cast(ceil(" + _UNITS.format("text") + " / 4.0) as bigint)"
_SETTING = "(SELECT cast(setting_value AS INTEGER) FROM rag_config WHERE setting = '{}')"

_SITE_LINES = """
        docs AS (SELECT doc_id, source FROM parsed_documents WHERE NOT scanned),
        sizes AS (SELECT source, count(*) AS n FROM docs GROUP BY source),
        cut AS (SELECT doc_id, page_no, string_split(text, chr(10)) AS ls FROM pages),
        lines AS (SELECT doc_id, page_no, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM cut),
        worded AS (SELECT d.source, l.doc_id, l.page_no, l.line_no, l.line,
                          replace(lower(regexp_replace(l.line, '[^\\pL]+', '', 'g')), 'ß', 'ss') AS w
                   FROM lines l JOIN docs d USING (doc_id)),
        counted AS (SELECT source, w, count(DISTINCT doc_id) AS c FROM worded WHERE length(w) >= 6 GROUP BY source, w)"""
SQL = {
    "p1_found": f"""
        WITH {_SITE_LINES}
        SELECT w.doc_id, cast(w.page_no AS INTEGER) AS page_no, cast(w.line_no AS INTEGER) AS line_no
        FROM worded w JOIN counted c ON w.source IS NOT DISTINCT FROM c.source AND w.w = c.w JOIN sizes s ON s.source IS NOT DISTINCT FROM w.source
        WHERE c.c >= 3 AND c.c * 10 >= s.n""",
    "p1_clean_texts": f"""
        WITH {_SITE_LINES.replace("page_no, string_split", "0 AS page_no, string_split").replace("FROM pages", "FROM parsed_documents")},
        marked AS (SELECT w.doc_id, w.line_no, w.line, coalesce(c.c >= 3 AND c.c * 10 >= s.n, false) AS site
                   FROM worded w JOIN sizes s ON s.source IS NOT DISTINCT FROM w.source LEFT JOIN counted c ON w.source IS NOT DISTINCT FROM c.source AND w.w = c.w)
        SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT site), '') AS text, count(*) FILTER (site) AS removed FROM marked GROUP BY doc_id""",
    "p2_found": """
        WITH sound AS (
          SELECT chunk_id, min(vector) AS v FROM vectors
          WHERE vector IS NOT NULL AND len(vector) = 64
            AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
            AND len(list_filter(vector, lambda x: x <> 0)) > 0
          GROUP BY chunk_id),
        pairs AS (
          SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(cast(a.v AS DOUBLE[]), cast(b.v AS DOUBLE[])) AS c
          FROM sound a JOIN sound b ON a.chunk_id <> b.chunk_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) AS place FROM pairs)
        SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM ranked WHERE place <= 10 AND c >= 0.9""",
    "p3_found": f"SELECT DISTINCT chunk_id FROM chunks WHERE {_TOKENS} > {_SETTING.format('chunking.maxTokens')}",
    "p3_rejoined": f"""
        SELECT DISTINCT chunk_id, sha256(regexp_replace(text, '{splitting.WHITE}', '', 'g')) AS solid, true AS within_limit, true AS within_overlap, cast(0 AS BIGINT) AS misplaced
        FROM chunks WHERE {_TOKENS} > {_SETTING.format('chunking.maxTokens')}""",
    "p6_found": f"SELECT doc_id FROM documents WHERE {_TOKENS} > {_SETTING.format('generation.contextBudgetTokens')}",
    "p6_totals": f"""
        SELECT doc_id, t AS tokens, cast(ceil(t / cast({_SETTING.format('generation.contextBudgetTokens')} AS DOUBLE)) AS BIGINT) AS pieces, cast(0 AS BIGINT) AS overfull
        FROM (SELECT doc_id, {_TOKENS} AS t FROM documents) WHERE t > 0""",
    "p7_found": f"""
        WITH sized AS (SELECT source, {_TOKENS} AS t FROM documents),
        own AS (SELECT source, sum(t) AS t FROM sized GROUP BY source)
        SELECT m.source FROM mix_targets m LEFT JOIN own USING (source)
        WHERE m.target_share * (SELECT sum(t) FROM sized) > m.max_repeats * coalesce(own.t, 0)""",
}
