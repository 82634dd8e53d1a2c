"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm import chunks, lookalikes, mixture, neighbours, sampling, scans, tokens, topn
from foliospark.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that a chunking has to cut: those with a second piece."""
    pieces = chunks.split_oversized(table(spark, sf, "documents"), chunks.chunkings_of(table(spark, sf, "chunking")), with_text=False)
    return pieces.where("piece = 2").select("chunking_name", "doc_id").distinct()


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """All pieces of all documents for all chunkings."""
    return chunks.split_oversized(table(spark, sf, "documents"), chunks.chunkings_of(table(spark, sf, "chunking")))


def p1_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Of every document and chunking: the words that its pieces hold in order without a gap, and pieces over the limit or with another overlap."""
    sets = chunks.chunkings_of(table(spark, sf, "chunking"))
    limits = spark.createDataFrame([(c.name, c.max_words, c.overlap_words) for c in sets], "chunking_name string, max_words int, overlap_words int")
    pieces = chunks.split_oversized(table(spark, sf, "documents"), sets, with_text=False).join(F.broadcast(limits), "chunking_name")
    before = Window.partitionBy("chunking_name", "doc_id").orderBy("piece")
    end = F.coalesce(F.lag(F.col("first_word") + F.col("words")).over(before), F.lit(0))
    right = (F.col("first_word") == end - F.col("shared_words")) & (F.col("shared_words") == F.when(F.col("piece") == 1, 0).otherwise(F.col("overlap_words")))
    return pieces.withColumn("right", right).groupBy("chunking_name", "doc_id").agg(
        F.sum(F.when(F.col("right"), F.col("words") - F.col("shared_words"))).alias("covered"), F.count_if(F.col("words") > F.col("max_words")).alias("over"), F.count_if(~F.col("right")).alias("wrong")
    )


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The k best documents of every scorer and query."""
    limited = topn.with_limits(table(spark, sf, "scores").select("scorer", "query_id", "document_id", "score"), table(spark, sf, "scorer_results"))
    return topn.top_n(limited, ["scorer", "query_id"], "document_id", "score", "limit_of_scorer").select("scorer", "query_id", "place", "document_id")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The kinds of scanning noise in every document."""
    return scans.find_noise(table(spark, sf, "documents"))


def p3_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as continuous paragraphs."""
    return scans.repair(table(spark, sf, "documents"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of documents of which either is among the 5 most similar of the other, from a cosine of 0.80."""
    return neighbours.similar_pairs(table(spark, sf, "doc_mean"), "document_id", "mean_embedding")


def p4_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """For every active token vector the 5 most similar token vectors of other pages."""
    vectors = table(spark, sf, "doc_tok").where("coalesce(mask, true)").withColumn("token", F.concat_ws(":", "document_id", "pos"))
    return neighbours.nearest(vectors, "token", "embedding", owner="document_id", least=-1.0, turns=4, window=4096)


#: Days from a task's first query in which its founding queries come.
FOUNDING_DAYS = 90.0


def p5_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The queries and page ids selected for every specification.

    Queries arrive by ``added_at``, found in their task's first FOUNDING_DAYS; pages by ``batch_no``, then
    ``added_at``, and the first batch founds.
    """
    specs = table(spark, sf, "selection_specs")
    asked = table(spark, sf, "queries").where(F.trim("query") != "")
    days = lambda c: F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', cast({c} as timestamp_ntz))") / F.lit(86_400e6)
    asked = sampling.stable_sample(asked, "task", "query-id", days("added_at"), sampling.wanted_of(specs, "queries_per_task"), "query", span=FOUNDING_DAYS)
    pages = sampling.stable_sample(table(spark, sf, "image_documents"), "task", "document_id", F.col("batch_no"), sampling.wanted_of(specs, "documents_per_task"), "document", then=days("added_at"))
    return asked.unionByName(pages).withColumnRenamed("stratum", "task").withColumnRenamed("item", "id")


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """Records of all sources, repeated to their target shares."""
    return mixture.mix(table(spark, sf, "documents"), mixture.weights_of(table(spark, sf, "source_weights")))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares that the mixture reaches."""
    return mixture.shares(p7_mixture(spark, sf).drop("text"), mixture.weights_of(table(spark, sf, "source_weights")))


def p7_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Of each source with a weight and documents: whether no record is used more than allowed, and whether it has its share or all it can give."""
    reached = p7_shares(spark, sf).where("records > 0")
    total = F.sum("target_share").over(Window.partitionBy(F.lit(1)))
    near = F.abs(F.col("share") - F.col("target_share") / total) <= 0.01
    return reached.select("source", (F.col("most_uses") <= F.col("max_repeats")).alias("within_cap"), near.alias("near_target"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The token ids of every document."""
    return tokens.encode(table(spark, sf, "documents"))


def p6_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose ids decode to another text than theirs: none."""
    ids = table(spark, sf, "documents").join(p6_ids(spark, sf), "doc_id")
    return tokens.decode(ids, text="decoded").where("decoded <> coalesce(text, '')").select("doc_id", "decoded")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of documents that look the same in different characters."""
    return lookalikes.lookalike_pairs(table(spark, sf, "documents"))


def p8_normalized(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's text in its consistent form."""
    return lookalikes.normalize(table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_pieces, p1_cover, p2_found, p3_found, p3_repaired, p4_found, p4_tokens, p5_sample, p6_ids, p6_decoded, p7_mixture, p7_shares, p7_bounds, p8_found, p8_normalized)
}

_SPACE = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"



def _sample_sql(kind: str, rows: str, span: float, target: str) -> str:
    """The stable sample of ``rows`` (stratum, item, arrival, t) by numbers and fixed intervals."""
    low, golden = sampling.LOW, sampling.GOLDEN
    return f"""
{kind}_items AS (
  SELECT stratum, item, CASE WHEN count(arrival) = count(*) THEN min(arrival) END AS arrival, CASE WHEN count(arrival) = count(*) THEN arg_min(t, (arrival, t)) END AS t, sha256(item) AS sign
  FROM ({rows}) WHERE stratum IS NOT NULL AND item IS NOT NULL GROUP BY stratum, item),
{kind}_numbers AS (
  SELECT stratum, item, row_number() OVER (PARTITION BY stratum ORDER BY arrival, t NULLS FIRST, sign, item) AS n FROM {kind}_items WHERE arrival IS NOT NULL
  UNION ALL SELECT stratum, item, CAST('0x' || substr(sign, 1, 12) AS BIGINT) FROM {kind}_items WHERE arrival IS NULL),
{kind}_firsts AS (SELECT stratum, min(arrival) AS first FROM {kind}_items GROUP BY stratum),
{kind}_sizes AS (SELECT stratum, count(*) AS founding FROM {kind}_items JOIN {kind}_firsts USING (stratum) WHERE first IS NULL OR arrival <= first + {span}::DOUBLE GROUP BY stratum),
{kind}_plans AS (
  SELECT DISTINCT task AS stratum, salt, CAST('0x' || substr(sha256(salt || chr(0) || '{kind}' || chr(0) || task), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS shift, {target} / ({sampling.PLANNED}::DOUBLE * founding) AS width
  FROM selection_specs s JOIN {kind}_sizes z ON z.stratum = s.task WHERE salt IS NOT NULL AND {target} > 0),
{kind}_parts AS (
  SELECT stratum, salt, item, width, (n % {low}) * {float(golden)!r}::DOUBLE + (n // {low}) * {float(golden * low % 1)!r}::DOUBLE + shift AS part FROM {kind}_numbers JOIN {kind}_plans USING (stratum)),
{kind}_sample AS (SELECT stratum AS task, salt, '{kind}' AS kind, item AS id FROM {kind}_parts WHERE part - floor(part) < width)"""


_SAMPLE = "WITH " + _sample_sql("query", """SELECT task AS stratum, CAST("query-id" AS VARCHAR) AS item, epoch_us(added_at) / 86400e6::DOUBLE AS arrival, NULL::DOUBLE AS t FROM queries WHERE trim(query) <> ''""", FOUNDING_DAYS, "queries_per_task")
_SAMPLE += "," + _sample_sql("document", "SELECT task AS stratum, document_id AS item, batch_no::DOUBLE AS arrival, epoch_us(added_at) / 86400e6::DOUBLE AS t FROM image_documents", 0.0, "documents_per_task")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _letters(at: int) -> str:
    """Of single characters that are drawn as another one, these (0) or the others (1); of look-alike letters, with accents (2 and 3)."""
    table = lookalikes.FOLD if at < 2 else lookalikes.CLASSES | lookalikes.CLASS_OF
    one = {chr(c): t for c, t in table.items() if len(t) == 1}
    return _quoted("".join(one.values() if at % 2 else one))


def _looks_sql() -> str:
    """A text's look but for letters: ignorable characters out (a soft hyphen at a line's end shows), width forms and ligatures replaced."""
    looks = f"regexp_replace(regexp_replace(text, '\\x{{AD}}([ \\t]*(?:\\r?\\n|\\x0c|$))', '-\\1', 'g'), '[{lookalikes.IGNORABLE}]', '', 'g')"
    looks = f"translate({looks}, {_letters(0)}, {_letters(1)})"
    for c, t in lookalikes.FOLD.items():
        if len(t) > 1:
            looks = f"replace({looks}, {_quoted(chr(c))}, {_quoted(t)})"
    return f"replace({looks}, chr(13) || chr(10), chr(10))"


def _accented_sql(text: str) -> str:
    """Look-alike letters whose accent has no composed form in Latin, replaced."""
    for c, t in lookalikes.CLASSES.items():
        if len(t) > 1:
            text = f"replace({text}, {_quoted(chr(c))}, {_quoted(t)})"
    return text


ORACLE: dict[str, str] = {
    "p1_cover": rf"""
SELECT c.chunking_name, d.doc_id, CAST(d.words AS BIGINT) AS covered, CAST(0 AS BIGINT) AS over, CAST(0 AS BIGINT) AS wrong
FROM (SELECT doc_id, len(regexp_extract_all(text, '[^{_SPACE}]+')) AS words FROM documents WHERE text IS NOT NULL) d, chunking c""",
    "p8_found": f"""
WITH looks AS (SELECT DISTINCT doc_id, text, nfc_normalize(translate({_accented_sql(f"nfc_normalize({_looks_sql()})")}, {_letters(2)}, {_letters(3)})) AS look FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM looks a JOIN looks b USING (look) WHERE a.doc_id < b.doc_id AND a.text <> b.text AND regexp_matches(look, '[^{_SPACE}]')""",
    "p5_sample": f"{_SAMPLE} SELECT * FROM query_sample UNION ALL SELECT * FROM document_sample",
    "p7_bounds": """
SELECT DISTINCT w.source, true AS within_cap, true AS near_target FROM source_weights w JOIN documents d ON d.source = w.source WHERE d.text <> '' AND w.target_share > 0 AND w.max_repeats > 0""",
    "p1_found": rf"""
SELECT DISTINCT c.chunking_name, d.doc_id
FROM (SELECT doc_id, len(regexp_extract_all(text, '[^{_SPACE}]+')) AS words FROM documents WHERE text IS NOT NULL) d
JOIN chunking c ON d.words > c.max_words""",
    "p2_found": """
WITH best AS (
  SELECT s.scorer, s.query_id, s.document_id, max(s.score) AS score, max(r.k) AS k
  FROM scores s JOIN (SELECT scorer, max(k) AS k FROM scorer_results GROUP BY scorer) r ON s.scorer = r.scorer
  WHERE s.score IS NOT NULL AND NOT isnan(s.score) AND NOT isinf(s.score) AND s.document_id IS NOT NULL
  GROUP BY s.scorer, s.query_id, s.document_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY scorer, query_id ORDER BY score DESC, document_id DESC) AS place FROM best)
SELECT scorer, query_id, CAST(place AS INTEGER) AS place, document_id FROM ranked WHERE place <= k""",
    "p4_found": """
WITH v AS (
  SELECT document_id, max(mean_embedding)::DOUBLE[] AS e FROM doc_mean
  WHERE document_id IS NOT NULL AND len(mean_embedding) = 128 AND len(list_filter(mean_embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(mean_embedding, lambda x: x <> 0)) > 0 GROUP BY document_id),
u AS (SELECT document_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
sims AS (SELECT a.document_id AS a, b.document_id AS b, list_dot_product(a.e, b.e) / (a.n * b.n) AS s FROM u a JOIN u b ON a.document_id <> b.document_id),
near AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b DESC) AS place FROM sims) WHERE place <= 5 AND s >= 0.8)
SELECT DISTINCT least(a, b) AS document_a, greatest(a, b) AS document_b FROM near""",
}
