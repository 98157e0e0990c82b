"""Queries of the training-text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions.text import normalized_names, plain_sha
from graphmill.llm import components, handwritten, mixing, packing, readability, terms, tokens
from graphmill.workspace import cut, table

CAPACITY = 2048


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every linked symbol per revision with the group's smallest symbol."""
    return components.linked_groups(table(spark, d, "edges").select("rev", "src", "dst"), "rev", "src", "dst")


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups per revision with their sizes."""
    return p3_found(spark, d).groupBy("rev", "group_id").agg(F.count(F.lit(1)).alias("n_nodes"))


def _term_counts(spark: SparkSession, d: str) -> DataFrame:
    refs = normalized_names(table(spark, d, "blob_refs").select("blob_sha", "ordinal", "raw_name"), "raw_name", "term")
    refs = refs.select(F.lit("raw_name").alias("field"), plain_sha(F.col("blob_sha")).alias("blob_sha"), "term", "ordinal", F.lit(0).alias("pos"))
    parts = table(spark, d, "blob_nodes").select("blob_sha", "ordinal", F.posexplode(F.split("qualname", r"\.")).alias("pos", "part"))
    parts = normalized_names(parts.where("part != '<locals>'"), "part", "term").where("term != ''")
    parts = parts.select(F.lit("qualname").alias("field"), plain_sha(F.col("blob_sha")).alias("blob_sha"), "term", "ordinal", "pos")
    return terms.term_frequencies(refs.unionByName(parts), ["field"], "blob_sha", "term", ["ordinal", "pos"])


def _marked(spark: SparkSession, d: str) -> DataFrame:
    total = table(spark, d, "blobs").select(plain_sha(F.col("blob_sha")).alias("s")).agg(F.count_distinct("s")).first()[0]
    return _term_counts(spark, d).withColumn("mark", terms.frequency_mark(F.col("n_records"), total))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Names and parts of qualified names that are too rare or too common."""
    return _marked(spark, d).where(F.col("mark").isNotNull()).select("field", "term", "mark")


def p4_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Every name and part with its occurrences, its texts, and its mark."""
    return _marked(spark, d)


def _files(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.classify_files(table(spark, d, "tree"), table(spark, d, "blob_texts").select("blob_sha", "content"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that nobody here wrote by hand."""
    return _files(spark, d).where(~F.col("verdict").isin("hand", "empty")).select("path", "blob_sha")


def p5_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Every file with its layout statistics and verdict."""
    return _files(spark, d)


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """Documents in tokens, counted once."""
    return cut(table(spark, d, "documents").select("doc_id", "source", tokens.token_count(F.col("text")).alias("tokens")))


def p6_method(spark: SparkSession, d: str) -> DataFrame:
    """Containers of 2,048 tokens by the harmonic classes' fixed counts alone."""
    return packing.container_report(packing.harmonic_containers(_sized(spark, d), "doc_id", "tokens", CAPACITY, fill_up=False), CAPACITY)


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Containers of 2,048 tokens with their documents and fill."""
    return packing.container_report(packing.harmonic_containers(_sized(spark, d), "doc_id", "tokens", CAPACITY), CAPACITY)


def p6_summary(spark: SparkSession, d: str) -> DataFrame:
    """How well the containers are filled."""
    report = p6_containers(spark, d)
    return report.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n_items").alias("n_pieces"), F.sum("used").alias("n_tokens"), F.round(F.sum("used") / (F.count(F.lit(1)) * CAPACITY), 6).alias("fill"), F.max("used").alias("most_used"))


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """What every packing must hold, as counts: documents packed, and violations of each rule."""
    sized = _sized(spark, d).where("tokens > 0")
    packed = cut(packing.harmonic_containers(sized, "doc_id", "tokens", CAPACITY))
    whole = sized.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("copies"))
    placed = packed.groupBy("item").agg(F.sum("length").alias("length"), F.max("piece").alias("piece"))
    x = whole.join(placed, whole.doc_id.eqNullSafe(placed.item), "full")
    counts = x.agg(F.count("item").alias("documents_packed"), F.count_if(~F.col("tokens").eqNullSafe(F.col("length"))).alias("tokens_lost"), F.count_if((F.col("piece") > 0) & (F.col("tokens") <= CAPACITY * F.col("copies"))).alias("short_ones_split"))
    over = packed.groupBy("container_id").agg(F.sum("length").alias("used")).agg(F.count_if(F.col("used") > CAPACITY).alias("overfull"))
    listed = [x.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("n")) for c in x.columns])).alias("x")).select("x.*") for x in (counts, over)]
    return listed[0].unionByName(listed[1])


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the mix with their copies."""
    return mixing.mix(_sized(spark, d), "doc_id", "source", "tokens", table(spark, d, "source_targets"))[0].withColumnsRenamed({"item": "doc_id", "size": "tokens"})


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source."""
    return mixing.mix(_sized(spark, d), "doc_id", "source", "tokens", table(spark, d, "source_targets"))[1]


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per target what every mix must hold: documents to draw from, repeats within the limit, and the share met to within a document of every source."""
    sized = _sized(spark, d).where("tokens > 0 and doc_id is not null")
    chosen, report = mixing.mix(sized, "doc_id", "source", "tokens", table(spark, d, "source_targets"))
    held = sized.groupBy("doc_id").agg(F.max(F.struct(mixing.plain_source(F.col("source")).alias("source"), "tokens")).alias("x")).groupBy("x.source").agg(F.count(F.lit(1)).alias("held"), F.max("x.tokens").alias("longest"))
    chosen = cut(chosen)
    total = chosen.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 1
    often = chosen.groupBy("source").agg(F.max("copies").alias("copies"))
    slack = held.agg(F.sum("longest")).first()[0] or 0
    x = report.join(held, "source", "left").join(often, "source", "left")
    met = F.abs(F.col("wanted_share") - F.col("actual_share")) * F.lit(float(total)) <= F.lit(float(slack))
    return x.select("source", F.coalesce("held", F.lit(0)).alias("held"), (F.coalesce("copies", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), met.alias("share_met"))


def p8_method(spark: SparkSession, d: str) -> DataFrame:
    """Levels and bands by the dichotomous Rasch model alone: whether a word occurs, not in which band."""
    return readability.occurrence_levels(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "level_labels"))


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    """Reading levels and band shares of English documents."""
    return readability.reading_levels(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "level_labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Reading band of English documents with enough prose."""
    return p8_levels(spark, d).select("doc_id", "band")


QUERIES = {
    "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p4_frequencies": p4_frequencies, "p5_found": p5_found, "p5_verdicts": p5_verdicts,
    "p6_method": p6_method, "p6_containers": p6_containers, "p6_summary": p6_summary, "p6_checks": p6_checks, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_checks": p7_checks, "p8_method": p8_method, "p8_found": p8_found, "p8_levels": p8_levels,
}

_GROUPS = """
    WITH RECURSIVE l AS (SELECT DISTINCT rev, src, dst FROM edges WHERE rev IS NOT NULL AND src <> '' AND dst <> '' AND src <> dst),
    sym AS (SELECT rev, src AS a, dst AS b FROM l UNION SELECT rev, dst, src FROM l),
    cc(rev, node_id, group_id) USING KEY (rev, node_id) AS (
        SELECT DISTINCT rev, a, a FROM sym
        UNION
        SELECT n.rev, n.node_id, n.low FROM (SELECT s.rev, s.b AS node_id, min(c.group_id) AS low FROM cc c JOIN sym s ON s.rev = c.rev AND s.a = c.node_id GROUP BY ALL) n
        JOIN recurring.cc r ON r.rev = n.rev AND r.node_id = n.node_id WHERE n.low < r.group_id
    )
"""

_NAME = r"nfc_normalize(regexp_replace({0}, '^[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+|[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+$', '', 'g'))"

_SOURCE = r"regexp_replace(lower(trim({0})), '[\s-]+', '_', 'g')"

_TERMS = f"""
    WITH o AS (
        SELECT DISTINCT 'raw_name' AS field, nullif(lower(blob_sha), '') AS s, {_NAME.format("raw_name")} AS term, ordinal, 0 AS pos FROM blob_refs WHERE raw_name IS NOT NULL
        UNION ALL
        SELECT DISTINCT 'qualname', nullif(lower(blob_sha), ''), {_NAME.format("part")}, ordinal, pos FROM (SELECT blob_sha, ordinal, unnest(string_split(qualname, '.')) AS part, generate_subscripts(string_split(qualname, '.'), 1) AS pos FROM blob_nodes)
        WHERE part <> '<locals>' AND trim(part) <> ''
    ),
    f AS (SELECT field, term, count(*) AS n_occurrences, count(DISTINCT s) AS n_records FROM o WHERE s IS NOT NULL GROUP BY ALL),
    t AS (SELECT count(DISTINCT nullif(lower(blob_sha), '')) AS n FROM blobs),
    m AS (SELECT f.*, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records >= 0.05 * n THEN 'common' END AS mark FROM f, t)
"""

ORACLES = {
    "p3_found": f"{_GROUPS} SELECT rev, node_id, group_id FROM cc",
    "p3_groups": f"{_GROUPS} SELECT rev, group_id, count(*) AS n_nodes FROM cc GROUP BY ALL",
    "p4_found": f"{_TERMS} SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p4_frequencies": f"{_TERMS} SELECT * FROM m",
    "p6_checks": "SELECT 'documents_packed' AS rule, count(DISTINCT doc_id) AS n FROM documents WHERE text <> '' UNION ALL SELECT unnest(['overfull', 'short_ones_split', 'tokens_lost']), 0",
    "p7_checks": rf"""
        WITH d AS (SELECT doc_id, max({_SOURCE.format("source")}) AS source FROM documents WHERE text <> '' AND doc_id IS NOT NULL GROUP BY doc_id), h AS (SELECT source, count(*) AS held FROM d GROUP BY ALL)
        SELECT t.source, coalesce(held, 0) AS held, true AS within_repeats, true AS share_met FROM (SELECT DISTINCT {_SOURCE.format("source")} AS source FROM source_targets WHERE target_share > 0 AND max_repeats >= 1 AND source IS NOT NULL) t LEFT JOIN h USING (source)
    """,
}
