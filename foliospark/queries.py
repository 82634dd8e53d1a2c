"""Queries of the core engine and their SQL.

Searches take as queries the rows whose id is divisible by 20, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.numeric import geometric_mean
from foliospark.functions.text import chunk_windows as windows_of
from foliospark.functions.text import prompt, tokenize_plain, words
from foliospark.functions.vectors import finite, norm, normalized
from foliospark.operators import bm25, dense, fingerprints, loss, maxsim, metrics, pooling, ranking, samples, subset, validate
from foliospark.plans import reports
from foliospark.session import checkpointed, numbered, table
from foliospark.sources.images import load_subset, png_size

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
WIDTH, STATED, WORDS, OVERLAP = 128, 20, 192, 32
_SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with SQL that gives the same."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- Tables ------------------------------------------------------------------------------------------


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "queries").where((F.col("`query-id`") % STATED == 0) & F.col("query").isNotNull())
    return rows.select(F.col("`query-id`").cast("string").alias("query_id"), F.col("query").alias("text"))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """Judgements that hold: a score of 1, a query and a page that exist; each once."""
    qrels = table(spark, sf, "qrels")
    qrels = validate.relevant(qrels).join(table(spark, sf, "queries").select("query-id"), "query-id", "left_semi").join(table(spark, sf, "corpus").select("corpus-id"), "corpus-id", "left_semi")
    return qrels.select(F.col("`query-id`").cast("string").alias("query_id"), F.col("`corpus-id`").cast("string").alias("document_id")).distinct()


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "doc_tok").select("document_id", "pos", "mask", F.col("embedding").alias("emb"))


def _stated(df: DataFrame) -> DataFrame:
    return df.where(F.col("document_id").cast("bigint") % STATED == 0)


def _maxsim(spark: SparkSession, sf: str, k: int | None = None) -> DataFrame:
    tokens = _tokens(spark, sf)
    return maxsim.maxsim(_stated(tokens).withColumnRenamed("document_id", "query_id"), tokens, WIDTH, k=k, digits=4)


def _means(spark: SparkSession, sf: str) -> DataFrame:
    return checkpointed(pooling.mean_pool(_tokens(spark, sf), width=WIDTH))


def _pooled(spark: SparkSession, sf: str, k: int | None = None) -> DataFrame:
    means = _means(spark, sf)
    asked = _stated(means).select(F.col("document_id").alias("query_id"), F.col("vector").alias("emb"))
    return dense.scores(asked, means.withColumnRenamed("vector", "emb"), WIDTH, k=k, digits=4)


def _dense(spark: SparkSession, sf: str, k: int | None = None) -> DataFrame:
    rows = _stated(table(spark, sf, "doc_mean")).select("document_id", F.col("mean_embedding").alias("emb"))
    good = rows.where((F.size("emb") == WIDTH) & finite(F.col("emb")) & F.exists("emb", lambda x: x != 0))
    asked = good.groupBy(F.col("document_id").alias("query_id")).agg(F.max("emb").alias("emb"))
    return dense.scores(asked, maxsim.active(_tokens(spark, sf)), WIDTH, k=k, digits=4)


#: Indices of this process by application and files: an index is built once and then searched.
_INDEXES: dict[tuple, bm25.Index] = {}


def _index(spark: SparkSession, sf: str) -> bm25.Index:
    """The index of the documents, built anew if their files have changed or its tables were deleted."""
    meta = table(spark, sf, "documents").select("_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").cast("string").alias("at")).distinct()
    key = (spark.sparkContext.applicationId, *sorted(tuple(r) for r in meta.collect()))
    if key not in _INDEXES or not _INDEXES[key].stands():
        _INDEXES[key] = bm25.build(_pages(spark, sf), WORDS, OVERLAP, plain=True)
    return _INDEXES[key]


def _bm25(spark: SparkSession, sf: str) -> tuple[bm25.Index, DataFrame]:
    index = _index(spark, sf)
    return index, bm25.scores(index, _asked(spark, sf), digits=4)


def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Late-interaction scores of the stated pages (rows) against all pages (columns), by number."""
    ids = _tokens(spark, sf).select("document_id").where("document_id is not null").distinct()
    numbers = numbered(ids, "document_id", "n")
    scores = _maxsim(spark, sf)
    return scores.join(numbers.withColumnsRenamed({"document_id": "query_id", "n": "i"}), "query_id").join(numbers.withColumnsRenamed({"n": "j"}), "document_id").select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "score")


def _best_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every document once in its group, with its best finite score."""
    good = table(spark, sf, "scores").where("scorer is not null and query_id is not null and document_id is not null and score is not null and not isnan(score) and abs(score) < double('infinity')")
    return good.groupBy("scorer", "query_id", "document_id").agg(F.max("score").alias("score"))


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("value > 0").select(F.col("event_type").alias("candidate"), (F.col("user_id") % 4).alias("workload"), F.col("value").alias("latency_ms"), (F.col("user_id") % 2).alias("kind"))


_TERMS = r"""
terms AS (SELECT document_id, chunk, unnest(regexp_extract_all(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ'), '[\p{L}\p{N}]+')) AS term FROM chunks)"""
_CHUNKS = rf"""
split AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, regexp_extract_all(text, '[^{_SPACE}]+') AS w FROM documents WHERE text IS NOT NULL),
chunks AS (
  SELECT document_id, CAST(chunk AS INTEGER) AS chunk, w[chunk * {WORDS - OVERLAP} + 1 : chunk * {WORDS - OVERLAP} + {WORDS}] AS w, array_to_string(w[chunk * {WORDS - OVERLAP} + 1 : chunk * {WORDS - OVERLAP} + {WORDS}], ' ') AS text
  FROM (SELECT document_id, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - {WORDS}) / {WORDS - OVERLAP}.0)) AS BIGINT) + 1)) AS chunk FROM split))"""
_STATS = f"""
tf AS (SELECT term, document_id, chunk, count(*) AS tf FROM terms GROUP BY ALL),
lengths AS (SELECT c.document_id, c.chunk, coalesce(t.length, 0) AS length FROM chunks c LEFT JOIN (SELECT document_id, chunk, sum(tf) AS length FROM tf GROUP BY ALL) t USING (document_id, chunk)),
totals AS (SELECT count(*) AS n, avg(length) AS average FROM lengths),
raw AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
_ASKED = rf"""
asked AS (SELECT query_id, term, count(*) AS times FROM (
  SELECT CAST("query-id" AS VARCHAR) AS query_id, unnest(regexp_extract_all(replace(replace(lower(query), 'ß', 'ss'), 'ς', 'σ'), '[\p{{L}}\p{{N}}]+')) AS term
  FROM queries WHERE "query-id" % {STATED} = 0 AND query IS NOT NULL) GROUP BY ALL)"""
_BM25 = f"""
WITH {_CHUNKS}, {_TERMS}, {_STATS}, {_ASKED},
by_chunk AS (
  SELECT query_id, document_id, chunk, sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / average))) AS score
  FROM asked JOIN idf USING (term) JOIN tf USING (term) JOIN lengths USING (document_id, chunk), totals GROUP BY ALL),
scores AS (SELECT query_id, document_id, round(max(score), 4) AS score FROM by_chunk GROUP BY ALL)"""
_JUDGED = """
judged AS (SELECT DISTINCT CAST(q."query-id" AS VARCHAR) AS query_id, CAST(q."corpus-id" AS VARCHAR) AS document_id FROM qrels q
  WHERE q.score = 1 AND q."query-id" IN (SELECT "query-id" FROM queries) AND q."corpus-id" IN (SELECT "corpus-id" FROM corpus))"""


def _metrics_sql(ranked: str, k: int, by: str = "") -> str:
    """Metrics of a relation ``ranked`` against ``judged``."""
    lead = f"{by}, " if by else ""
    return f"""
relevant AS (SELECT query_id, count(*) AS relevant FROM judged GROUP BY query_id),
frame AS (SELECT DISTINCT {lead}query_id, relevant FROM {ranked} JOIN relevant USING (query_id)),
gains AS (SELECT {lead}query_id, sum(1 / log2(rank + 1)) AS dcg, count(*) AS hits, min(rank) AS first FROM {ranked} JOIN judged USING (query_id, document_id) WHERE rank <= {k} GROUP BY ALL),
each_query AS (
  SELECT {lead}f.query_id, coalesce(dcg, 0) / (SELECT sum(1 / log2(r + 1)) FROM range(1, CAST(least(f.relevant, {k}) AS BIGINT) + 1) t(r)) AS ndcg,
    coalesce(hits, 0) / f.relevant::DOUBLE AS recall, coalesce(1.0::DOUBLE / first, 0) AS rr
  FROM frame f LEFT JOIN gains g USING ({lead}query_id))
SELECT {lead}round(avg(ndcg), 6) AS ndcg_at_{k}, round(avg(recall), 6) AS recall_at_{k}, round(avg(rr), 6) AS mrr_at_{k}, count(*) AS queries FROM each_query {f"GROUP BY {by}" if by else ""}"""


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


_TOKENS = """
toks AS (SELECT document_id, pos, bool_or(coalesce(mask, true)) AS active, arg_max(embedding, coalesce(mask, true)) AS emb FROM doc_tok GROUP BY ALL),
acts AS (SELECT document_id, pos, emb::DOUBLE[] AS emb FROM toks WHERE active)"""
_MAXSIM = f"""
WITH {_TOKENS},
pages AS (SELECT document_id, count(nullif(active, false)) AS n FROM toks GROUP BY ALL),
best AS (SELECT q.document_id AS query_id, d.document_id, q.pos, max(list_dot_product(q.emb, d.emb)) AS best FROM acts q, acts d WHERE CAST(q.document_id AS BIGINT) % {STATED} = 0 GROUP BY ALL),
sums AS (SELECT query_id, document_id, sum(best) AS total FROM best GROUP BY ALL),
scores AS (
  SELECT q.document_id AS query_id, d.document_id, round(CASE WHEN q.n = 0 THEN 0.0::DOUBLE WHEN d.n = 0 THEN '-inf'::DOUBLE ELSE s.total END, 4) AS score
  FROM pages q JOIN pages d ON CAST(q.document_id AS BIGINT) % {STATED} = 0 LEFT JOIN sums s ON s.query_id = q.document_id AND s.document_id = d.document_id)"""
_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id DESC) AS rank FROM scores WHERE isfinite(score))"
_SELF = f"judged AS (SELECT DISTINCT document_id AS query_id, document_id FROM doc_tok WHERE CAST(document_id AS BIGINT) % {STATED} = 0)"
_MEANS = f"""
WITH {_TOKENS},
dims AS (SELECT document_id, dim, avg(x) AS m FROM (SELECT document_id, unnest(emb) AS x, unnest(range(1, 129)) AS dim FROM acts) GROUP BY ALL),
means AS (SELECT document_id, list(m / n ORDER BY dim) AS vector FROM dims JOIN (SELECT document_id, sqrt(sum(m * m)) AS n FROM dims GROUP BY ALL) USING (document_id) WHERE isfinite(n) AND n > 0 GROUP BY ALL)"""
_POOLED = f"""{_MEANS},
scores AS (SELECT q.document_id AS query_id, d.document_id, round(list_dot_product(q.vector, d.vector), 4) AS score FROM means q, means d WHERE CAST(q.document_id AS BIGINT) % {STATED} = 0)"""
_DENSE = f"""
WITH {_TOKENS},
asked AS (SELECT document_id AS query_id, max(mean_embedding)::DOUBLE[] AS v FROM doc_mean WHERE CAST(document_id AS BIGINT) % {STATED} = 0 AND len(mean_embedding) = 128
  AND len(list_filter(mean_embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(mean_embedding, lambda x: x <> 0)) > 0 GROUP BY ALL),
scores AS (SELECT query_id, document_id, round(max(list_dot_product(v, emb) / sqrt(list_dot_product(v, v) * list_dot_product(emb, emb))), 4) AS score FROM asked, acts GROUP BY ALL)"""
_TOP = "SELECT query_id, document_id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5"


# ---- Late interaction, pooling, dense chunks ------------------------------------------------------------


@query(f"{_MAXSIM} SELECT * FROM scores")
def maxsim_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Late-interaction scores of the stated pages against all pages with token vectors."""
    return _maxsim(spark, sf)


@query(f"{_MAXSIM}, {_RANKED} {_TOP}")
def maxsim_top5(spark: SparkSession, sf: str) -> DataFrame:
    """The five best pages of each stated page."""
    return ranking.rank_scores(_maxsim(spark, sf, 5), k=5)


@query(f"{_MAXSIM}, {_RANKED}, {_SELF}, {_metrics_sql('ranked', 5)}")
def maxsim_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """How well each stated page finds itself by late interaction."""
    stated = _stated(_tokens(spark, sf)).select(F.col("document_id").alias("query_id"), "document_id").distinct()
    return _rounded(metrics.retrieval_metrics(ranking.rank_scores(_maxsim(spark, sf, 5), k=5), stated, 5))


@query(f"{_MEANS} SELECT document_id, CAST(dim AS INTEGER) AS dim, round(x, 5) AS value FROM (SELECT document_id, unnest(vector) AS x, unnest(range(0, 128)) AS dim FROM means)")
def mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Unit means of the active token vectors, dimension by dimension."""
    return pooling.mean_pool(_tokens(spark, sf), width=WIDTH).select("document_id", F.posexplode("vector").alias("dim", "value")).withColumn("value", F.round("value", 5))


@query(f"{_POOLED}, {_RANKED} {_TOP}")
def mean_pool_top5(spark: SparkSession, sf: str) -> DataFrame:
    """The five best pages of each stated page by mean vectors."""
    return ranking.rank_scores(_pooled(spark, sf, 5), k=5)


@query(f"{_POOLED}, {_RANKED}, {_SELF}, {_metrics_sql('ranked', 5)}")
def mean_pool_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """How well each stated page finds itself by mean vectors."""
    stated = _stated(_tokens(spark, sf)).select(F.col("document_id").alias("query_id"), "document_id").distinct()
    return _rounded(metrics.retrieval_metrics(ranking.rank_scores(_pooled(spark, sf, 5), k=5), stated, 5))


@query(f"{_DENSE}, {_RANKED} {_TOP}")
def dense_top5(spark: SparkSession, sf: str) -> DataFrame:
    """The five pages whose best chunk vector is most like each stated page's vector."""
    return ranking.rank_scores(_dense(spark, sf, 5), k=5)


@query("SELECT count(*) * (4 * 128 + 8) AS index_bytes FROM doc_tok")
def dense_index_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Logical bytes of the chunk vectors."""
    return dense.index_bytes(_tokens(spark, sf), WIDTH)


@query("""SELECT pages, positions * 513 AS token_bytes, pages * 512 AS mean_bytes, positions * 513 / pages::DOUBLE AS token_bytes_per_page, 512.0::DOUBLE AS mean_bytes_per_page, round(positions * 513 / (pages * 512.0::DOUBLE), 6) AS ratio
FROM (SELECT count(*) AS positions, count(DISTINCT document_id) AS pages FROM (SELECT DISTINCT document_id, pos FROM doc_tok))""")
def payload_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of token vectors and of mean vectors, in all and for a page."""
    return reports.payload(_tokens(spark, sf), WIDTH).withColumn("ratio", F.round("ratio", 6))


@query(f"""WITH {_TOKENS}, lengths AS (SELECT document_id, pos, emb, greatest(sqrt(list_dot_product(emb, emb)), 1e-12) AS n FROM (SELECT document_id, pos, CASE WHEN active THEN emb::DOUBLE[] ELSE list_transform(emb, lambda x: 0.0::DOUBLE) END AS emb FROM toks))
SELECT document_id, pos, round(emb[1] / n, 5) AS first, round(emb[128] / n, 5) AS last, round(sqrt(list_dot_product(emb, emb)) / n, 5) AS length FROM lengths""")
def normalized_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Token vectors of length one, masked ones zero: their first and last numbers and their lengths."""
    mask = F.coalesce("mask", F.lit(True))
    once = _tokens(spark, sf).groupBy("document_id", "pos").agg(F.max(F.struct(mask.alias("mask"), "emb")).alias("best")).select("document_id", "pos", "best.mask", "best.emb")
    vectors = once.withColumn("emb", F.when(F.col("mask"), normalized(F.col("emb"), 1e-12)).otherwise(F.transform("emb", lambda x: F.lit(0.0))))
    return vectors.select("document_id", "pos", F.round(F.get("emb", F.lit(0)), 5).alias("first"), F.round(F.get("emb", F.lit(WIDTH - 1)), 5).alias("last"), F.round(norm(F.col("emb")), 5).alias("length"))


# ---- BM25 ------------------------------------------------------------------------------------------------


@query(f"WITH {_CHUNKS}, {_TERMS} SELECT term, count(*) AS occurrences, count(DISTINCT document_id) AS documents FROM (SELECT CAST(doc_id AS VARCHAR) AS document_id, unnest(regexp_extract_all(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ'), '[\\p{{L}}\\p{{N}}]+')) AS term FROM documents) GROUP BY term")
def tokenize_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences and documents of every term."""
    terms = _pages(spark, sf).select("document_id", F.explode(tokenize_plain(F.col("text"))).alias("term"))
    counted = terms.groupBy("term", "document_id").agg(F.count(F.lit(1)).alias("tf"))
    return counted.groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count(F.lit(1)).alias("documents"))


@query(f"WITH {_CHUNKS} SELECT document_id, chunk, CAST(len(w) AS INTEGER) AS n_words, w[1] AS first_word, w[-1] AS last_word FROM chunks")
def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping windows of all documents."""
    cut = windows_of(_pages(spark, sf), "text", WORDS, OVERLAP)
    return cut.select("document_id", "chunk", F.size("words").alias("n_words"), F.try_element_at("words", F.lit(1)).alias("first_word"), F.try_element_at("words", F.lit(-1)).alias("last_word"))


@query(f"WITH {_CHUNKS}, {_TERMS}, {_STATS} SELECT term, df, round(idf, 5) AS idf FROM idf")
def bm25_term_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk frequency and floored inverse frequency of every term."""
    return _index(spark, sf).terms.withColumn("idf", F.round("idf", 5))


@query(f"WITH {_CHUNKS}, {_TERMS}, {_STATS} SELECT document_id, chunk, CAST(length AS INTEGER) AS length FROM lengths")
def bm25_chunk_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of every chunk, blank ones too."""
    return _index(spark, sf).chunks


@query(f"WITH {_CHUNKS}, {_TERMS}, {_STATS} SELECT CAST((SELECT sum(octet_length(encode(term)) + 8) FROM idf) + (SELECT 16 * count(*) FROM tf) + (SELECT 16 * count(*) FROM chunks) AS BIGINT) AS index_bytes")
def bm25_index_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Logical bytes of the index."""
    return _index(spark, sf).bytes()


@query(f"{_BM25} SELECT * FROM scores")
def bm25_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Non-zero page scores of the stated queries."""
    return _bm25(spark, sf)[1]


_BM25_TOP = f"""{_BM25},
grid AS (SELECT g.query_id, g.document_id, coalesce(score, 0.0::DOUBLE) AS score FROM (SELECT q.query_id, d.document_id FROM (SELECT DISTINCT CAST("query-id" AS VARCHAR) AS query_id FROM queries WHERE "query-id" % {STATED} = 0 AND query IS NOT NULL) q, (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS document_id FROM documents WHERE text IS NOT NULL) d) g LEFT JOIN scores s ON s.query_id = g.query_id AND s.document_id = g.document_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id DESC) AS rank FROM grid)"""


@query(f"{_BM25_TOP} {_TOP}")
def bm25_top5(spark: SparkSession, sf: str) -> DataFrame:
    """The five best pages of each stated query, pages without a match included."""
    return ranking.rank_scores(bm25.top_k(_index(spark, sf), _asked(spark, sf), 5, digits=4), k=5)


@query(f"{_BM25_TOP}, {_JUDGED}, {_metrics_sql('ranked', 5)}")
def bm25_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of BM25 over the stated queries that have a positive."""
    return _rounded(metrics.retrieval_metrics(bm25_top5(spark, sf), _judged(spark, sf), 5))


# ---- Loss --------------------------------------------------------------------------------------------------

_MATRIX = f"""{_MAXSIM},
numbers AS (SELECT document_id, row_number() OVER (ORDER BY document_id) - 1 AS n FROM (SELECT DISTINCT document_id FROM doc_tok WHERE document_id IS NOT NULL)),
matrix AS (SELECT a.n AS i, b.n AS j, score FROM scores JOIN numbers a ON a.document_id = query_id JOIN numbers b ON b.document_id = scores.document_id),
losses AS (SELECT i, positive, negative, greatest(negative - positive, 0) + ln(1 + exp(-abs(negative - positive))) AS loss FROM (
  SELECT i, max(CASE WHEN i = j THEN score END) AS positive, max(CASE WHEN i <> j AND score <> '-inf'::DOUBLE THEN score END) AS negative FROM matrix GROUP BY i))"""


@query(f"{_MATRIX} SELECT CAST(i AS INTEGER) AS i, positive, negative, round(loss, 6) AS loss FROM losses")
def loss_per_row(spark: SparkSession, sf: str) -> DataFrame:
    """Contrastive loss of every stated page, a row of the score matrix, against all pages."""
    return _rounded(loss.row_loss(_matrix(spark, sf)))


@query(f"{_MATRIX} SELECT round(avg(loss), 6) AS mean_loss, round(sum(loss), 4) AS sum_loss, count(*) AS rows FROM losses")
def loss_reduced(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and sum of the loss."""
    return loss.reduced_loss(_matrix(spark, sf)).select(F.round("mean_loss", 6).alias("mean_loss"), F.round("sum_loss", 4).alias("sum_loss"), "rows")


@query(f"{_MATRIX}, tops AS (SELECT i, arg_max(j, (score, -j)) AS j FROM matrix GROUP BY i) SELECT round(avg(CASE WHEN j = i THEN 1.0 ELSE 0.0 END), 6) AS top1_accuracy, round(min(positive - negative), 6) AS least_margin FROM losses JOIN tops USING (i)")
def ranking_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Top-1 accuracy and least margin of the score matrix."""
    return _rounded(loss.ranking_statistics(_matrix(spark, sf)))


@query(f"{_MATRIX} SELECT CAST(i AS INTEGER) AS i FROM matrix GROUP BY i HAVING count(nullif(i = j AND isfinite(score), false)) <> 1 OR count(nullif(isnan(score) OR score = 'inf'::DOUBLE, false)) > 0 OR count(nullif(i <> j AND isfinite(score), false)) = 0")
def loss_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the score matrix that the loss can't take."""
    return loss.matrix_violations(_matrix(spark, sf))


@query("""WITH m AS (SELECT scorer, CAST(query_id AS BIGINT) AS i, CAST(document_id AS BIGINT) AS j, score FROM scores)
SELECT scorer, i FROM m GROUP BY ALL HAVING count(nullif(i = j AND isfinite(score), false)) <> 1 OR count(nullif(score IS NULL OR isnan(score) OR score = 'inf'::DOUBLE, false)) > 0 OR count(nullif(i <> j AND isfinite(score), false)) = 0""")
def scorer_matrix_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each scorer's matrix of the score table that the loss can't take."""
    rows = table(spark, sf, "scores").select("scorer", F.col("query_id").cast("bigint").alias("i"), F.col("document_id").cast("bigint").alias("j"), "score")
    return loss.matrix_violations(rows, ("scorer",))


# ---- Rankings of the score table -----------------------------------------------------------------------------

_BEST = "best AS (SELECT scorer, query_id, document_id, max(score) AS score FROM scores WHERE scorer IS NOT NULL AND query_id IS NOT NULL AND document_id IS NOT NULL AND score IS NOT NULL AND isfinite(score) GROUP BY ALL)"
_ALL_RANKED = f"{_BEST}, ranked AS (SELECT *, row_number() OVER (PARTITION BY scorer, query_id ORDER BY score DESC, document_id DESC) AS rank FROM best)"


@query(f"WITH {_ALL_RANKED} SELECT scorer, query_id, document_id, score, CAST(rank AS INTEGER) AS rank FROM ranked")
def complete_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's rank for its scorer and query."""
    return ranking.rank_scores(_best_scores(spark, sf), ("scorer", "query_id"))


@query(f"WITH {_ALL_RANKED} SELECT scorer, query_id, string_agg(document_id, ' ' ORDER BY rank) AS documents FROM ranked WHERE rank <= 5 GROUP BY ALL")
def top_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The five best documents of each scorer and query, in order."""
    groups = ("scorer", "query_id")
    return ranking.top_lists(ranking.rank_scores(_best_scores(spark, sf), groups, k=5), 5, groups).withColumn("documents", F.array_join("documents", " "))


@query(f"WITH {_ALL_RANKED}, {_JUDGED}, {_metrics_sql('ranked', 10, 'scorer')}")
def scorer_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of every scorer."""
    return _rounded(metrics.retrieval_metrics(ranking.rank_scores(_best_scores(spark, sf), ("scorer", "query_id"), k=10), _judged(spark, sf), 10, ("scorer",)))


@query(f"WITH {_ALL_RANKED}, {_JUDGED} SELECT scorer, query_id, CAST(min(rank) AS INTEGER) AS first_relevant FROM ranked JOIN judged USING (query_id, document_id) GROUP BY ALL")
def first_relevant(spark: SparkSession, sf: str) -> DataFrame:
    """Rank of the first relevant document."""
    ranked = ranking.rank_scores(_best_scores(spark, sf), ("scorer", "query_id"))
    return ranked.join(_judged(spark, sf), ["query_id", "document_id"], "left_semi").groupBy("scorer", "query_id").agg(F.min("rank").alias("first_relevant"))


@query("""SELECT * FROM (SELECT scorer, query_id, count(nullif(score IS NULL OR NOT isfinite(score), false)) AS not_finite, count(document_id) - count(DISTINCT document_id) AS repeated, count(nullif(document_id IS NULL, false)) AS missing FROM scores GROUP BY ALL) WHERE not_finite > 0 OR repeated > 0 OR missing > 0""")
def score_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of the score table that break the contract of rankings."""
    return ranking.score_violations(table(spark, sf, "scores"), ("scorer", "query_id"))


@query(f"WITH {_ALL_RANKED} SELECT scorer, query_id, count(DISTINCT document_id) AS ranked FROM ranked GROUP BY ALL HAVING count(DISTINCT document_id) <> (SELECT count(*) FROM corpus)")
def incomplete_rankings(spark: SparkSession, sf: str) -> DataFrame:
    """Rankings that don't hold the whole corpus."""
    size = table(spark, sf, "corpus").count()
    return ranking.incomplete(_best_scores(spark, sf), size, ("scorer", "query_id"))


@query(f"""WITH {_BEST} SELECT count(*) AS pairs, round(max(abs(a.score - e.score)), 6) AS max_absolute_error, round(max(abs(a.score - e.score) / greatest(abs(e.score), 1e-12)), 4) AS max_relative_error, bool_and(isfinite(a.score) AND isfinite(e.score)) AS all_finite, bool_and(abs(a.score - e.score) <= 0.5::DOUBLE + 0.1::DOUBLE * abs(e.score)) AS all_close
FROM best a JOIN best e USING (query_id, document_id) WHERE a.scorer = 'late_interaction_maxsim' AND e.scorer = 'l2_normalized_masked_mean'""")
def agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Errors between two scorers over the pairs that both score."""
    best = _best_scores(spark, sf)
    found = samples.agreement(best.where("scorer = 'late_interaction_maxsim'"), best.where("scorer = 'l2_normalized_masked_mean'"), ["query_id", "document_id"], 0.5, 0.1)
    return found.withColumn("max_absolute_error", F.round("max_absolute_error", 6)).withColumn("max_relative_error", F.round("max_relative_error", 4))


@query(f"WITH {_JUDGED} SELECT query_id, string_agg(document_id, ' ' ORDER BY document_id) AS relevant FROM judged GROUP BY query_id")
def relevance_sets(spark: SparkSession, sf: str) -> DataFrame:
    """The sorted set of relevant pages of each query."""
    return _judged(spark, sf).groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("document_id")), " ").alias("relevant"))


@query(f"""WITH {_JUDGED}, asked AS (SELECT DISTINCT query_id FROM scores WHERE scorer = 'late_interaction_maxsim' AND query_id IS NOT NULL)
SELECT query_id AS id, 'unjudged' AS what FROM asked WHERE query_id NOT IN (SELECT query_id FROM judged) UNION ALL SELECT DISTINCT query_id, 'unranked' FROM judged WHERE query_id NOT IN (SELECT query_id FROM asked)
UNION ALL SELECT DISTINCT CAST("corpus-id" AS VARCHAR), 'unknown' FROM qrels WHERE "corpus-id" IS NOT NULL AND CAST("corpus-id" AS VARCHAR) NOT IN (SELECT document_id FROM documents)""")
def metric_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """What keeps one scorer's ranking from being measured: queries that only one side has, and judged pages that don't exist."""
    asked = table(spark, sf, "scores").where("scorer = 'late_interaction_maxsim' and query_id is not null").select("query_id")
    raw = table(spark, sf, "qrels").select(F.lit(None).cast("string").alias("query_id"), F.col("`corpus-id`").cast("string").alias("document_id")).where("document_id is not null")
    known = table(spark, sf, "documents").select("document_id")
    found = reports.coverage_violations(asked, _judged(spark, sf), known).where("what <> 'unknown'")
    return found.union(reports.coverage_violations(asked, raw, known).where("what = 'unknown'"))


@query(f"WITH {_ALL_RANKED}, {_JUDGED}, measured AS ({_metrics_sql('ranked', 10, 'scorer').strip().replace('relevant AS', 'WITH relevant AS', 1)}) SELECT scorer, ndcg_at_10, recall_at_10, mrr_at_10, queries, coalesce(ndcg_at_10 >= 0.05::DOUBLE, false) AS good, coalesce(queries >= 20, false) AS enough, coalesce(ndcg_at_10 >= 0.05::DOUBLE AND queries >= 20, false) AS accepted FROM measured")
def accepted_scorers(spark: SparkSession, sf: str) -> DataFrame:
    """Scorers that pass a gate of quality and number of queries."""
    return reports.accepted(scorer_metrics(spark, sf), {"good": F.col("ndcg_at_10") >= 0.05, "enough": F.col("queries") >= 20})


# ---- Integrity ---------------------------------------------------------------------------------------------


@query("""SELECT "query-id", "corpus-id", score, 'corpus' AS lacking FROM qrels WHERE CAST("corpus-id" AS VARCHAR) NOT IN (SELECT CAST("corpus-id" AS VARCHAR) FROM corpus)
UNION ALL SELECT "query-id", "corpus-id", score, 'queries' FROM qrels WHERE CAST("query-id" AS VARCHAR) NOT IN (SELECT CAST("query-id" AS VARCHAR) FROM queries)""")
def fk_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Judgements of pages or queries that don't exist."""
    qrels = table(spark, sf, "qrels")
    pages = validate.unknown_keys(qrels, "corpus-id", table(spark, sf, "corpus"), "corpus-id").withColumn("lacking", F.lit("corpus"))
    return pages.unionByName(validate.unknown_keys(qrels, "query-id", table(spark, sf, "queries"), "query-id").withColumn("lacking", F.lit("queries")))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE CAST(o_custkey AS VARCHAR) NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)")
def order_fk_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of customers that don't exist."""
    return validate.unknown_keys(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(spark, sf, "customer"), "c_custkey")


@query("""SELECT "query-id", "corpus-id", score FROM qrels WHERE score IS DISTINCT FROM 1""")
def relevance_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Judgements other than 1."""
    return validate.not_relevant(table(spark, sf, "qrels"))


@query("""SELECT document_id, count(*) AS rows FROM image_documents GROUP BY document_id HAVING count(*) > 1""")
def duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Page records delivered more than once."""
    return validate.duplicates(table(spark, sf, "image_documents"), "document_id")


@query("""SELECT "query-id", query FROM queries WHERE query IS NULL OR query = ''""")
def missing_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Queries without text."""
    return validate.missing_text(table(spark, sf, "queries").select("query-id", "query"), "query")


@query(f"""WITH {_JUDGED} SELECT CAST("query-id" AS VARCHAR) AS query_id FROM queries WHERE CAST("query-id" AS VARCHAR) NOT IN (SELECT query_id FROM judged)""")
def queries_without_positive(spark: SparkSession, sf: str) -> DataFrame:
    """Queries that no valid judgement names."""
    return table(spark, sf, "queries").select(F.col("`query-id`").cast("string").alias("query_id")).join(_judged(spark, sf), "query_id", "left_anti")


@query("""WITH a AS (SELECT DISTINCT document_id AS id FROM doc_mean), b AS (SELECT DISTINCT CAST("corpus-id" AS VARCHAR) AS id FROM corpus)
SELECT id, 'left' AS side FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, 'right' FROM b WHERE id NOT IN (SELECT id FROM a)""")
def coverage_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Pages without a vector, and vectors without a page."""
    return validate.coverage_difference(table(spark, sf, "doc_mean"), "document_id", table(spark, sf, "corpus"), "corpus-id")


@query('SELECT document_id, count(DISTINCT sha256) AS "values" FROM image_documents GROUP BY document_id HAVING count(DISTINCT sha256) > 1')
def digest_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Pages recorded with several digests."""
    return validate.conflicts(table(spark, sf, "image_documents"), "document_id", "sha256")


@query('SELECT document_id, count(DISTINCT image_format) AS "values" FROM image_documents GROUP BY document_id HAVING count(DISTINCT image_format) > 1')
def format_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Pages recorded with several spellings of their format."""
    return validate.conflicts(table(spark, sf, "image_documents"), "document_id", "image_format")


@query("""SELECT document_id, found, sha256 AS expected FROM (
  SELECT i.document_id, i.sha256, CASE WHEN c.image.bytes IS NOT NULL THEN sha256(c.image.bytes) END AS found FROM image_documents i JOIN corpus c ON CAST(c."corpus-id" AS VARCHAR) = i.document_id)
WHERE found IS DISTINCT FROM sha256""")
def artifact_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Page records whose digest isn't that of the stored image."""
    pages = table(spark, sf, "corpus").select(F.col("`corpus-id`").cast("string").alias("document_id"), F.col("image.bytes").alias("bytes"))
    both = table(spark, sf, "image_documents").select("document_id", "sha256").join(pages, "document_id")
    return validate.digest_mismatches(both, F.col("bytes"), F.col("sha256"), "document_id")


@query("""SELECT document_id, w AS found_width, h AS found_height, width, height FROM (
  SELECT i.document_id, i.width, i.height, CASE WHEN ok THEN CAST('0x' || substr(head, 33, 8) AS BIGINT) END AS w, CASE WHEN ok THEN CAST('0x' || substr(head, 41, 8) AS BIGINT) END AS h FROM image_documents i JOIN (
    SELECT CAST("corpus-id" AS VARCHAR) AS document_id, hex(image.bytes)[1:48] AS head, len(hex(image.bytes)) >= 48 AND starts_with(hex(image.bytes), '89504E470D0A1A0A0000000D49484452') AS ok FROM corpus) c USING (document_id))
WHERE w IS DISTINCT FROM width OR h IS DISTINCT FROM height""")
def image_size_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Page records whose size isn't that of the stored image, or whose image has none."""
    pages = table(spark, sf, "corpus").select(F.col("`corpus-id`").cast("string").alias("document_id"), png_size(F.col("image.bytes")).alias("size"))
    both = table(spark, sf, "image_documents").select("document_id", "width", "height").join(pages, "document_id")
    wrong = ~F.col("size.width").eqNullSafe(F.col("width").cast("bigint")) | ~F.col("size.height").eqNullSafe(F.col("height").cast("bigint"))
    return both.where(wrong).select("document_id", F.col("size.width").alias("found_width"), F.col("size.height").alias("found_height"), "width", "height")


@query("""SELECT CAST(row_index AS BIGINT) AS row_index, left_id, right_id FROM (SELECT row_number() OVER () - 1 AS row_index, CAST("corpus-id" AS VARCHAR) AS left_id FROM corpus)
FULL JOIN (SELECT row_number() OVER () - 1 AS row_index, document_id AS right_id FROM documents) USING (row_index) WHERE left_id IS DISTINCT FROM right_id""")
def row_order_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Places where the page table and the text table, each one file, name different pages."""
    return validate.row_order_mismatches(table(spark, sf, "corpus"), "corpus-id", table(spark, sf, "documents"), "document_id")


@query("""SELECT CAST(row_index AS BIGINT) AS row_index, left_id, right_id FROM (SELECT row_number() OVER () - 1 AS row_index, CAST("corpus-id" AS VARCHAR) AS left_id FROM corpus)
FULL JOIN (SELECT row_number() OVER () - 1 AS row_index, document_id AS right_id FROM image_documents) USING (row_index) WHERE left_id IS DISTINCT FROM right_id""")
def delivery_order_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Places where the page table and the record table name different pages."""
    return validate.row_order_mismatches(table(spark, sf, "corpus"), "corpus-id", table(spark, sf, "image_documents"), "document_id")


@query("""SELECT CAST(row_index AS BIGINT) AS row_index FROM (SELECT row_number() OVER () - 1 AS row_index, query AS found FROM queries)
FULL JOIN (SELECT row_index, query AS expected FROM (SELECT row_number() OVER () - 1 AS row_index, "query-id" FROM qrels) LEFT JOIN queries USING ("query-id")) USING (row_index) WHERE found IS DISTINCT FROM expected""")
def guard_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Places where the query table holds another text than the query that the judgement there names."""
    asked = table(spark, sf, "queries")
    return validate.guard_mismatches(asked, "query", table(spark, sf, "qrels"), "query-id", asked, "query-id", "query").select("row_index")


@query("""SELECT * FROM (SELECT document_id, count(nullif(coalesce(mask, true), false)) AS active, count(nullif(coalesce(mask, true) AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0, false)) AS not_finite,
  count(nullif(NOT coalesce(mask, true) AND len(list_filter(embedding, lambda x: isnan(x) OR x <> 0)) > 0, false)) AS masked_not_zero FROM doc_tok GROUP BY document_id) WHERE active = 0 OR not_finite > 0 OR masked_not_zero > 0""")
def token_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose token vectors break the encoding contract."""
    return validate.token_violations(_tokens(spark, sf), "document_id")


@query("""SELECT document_id, max(CASE WHEN coalesce(mask, true) THEN pos END) AS last_active, min(CASE WHEN NOT coalesce(mask, true) THEN pos END) AS first_masked FROM doc_tok GROUP BY document_id
HAVING max(CASE WHEN coalesce(mask, true) THEN pos END) > min(CASE WHEN NOT coalesce(mask, true) THEN pos END)""")
def padding_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with padding before or between active tokens."""
    return validate.not_right_padded(_tokens(spark, sf), "document_id")


@query("""WITH norms AS (SELECT coalesce(mask, true) AS active, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n, len(list_filter(embedding, lambda x: isnan(x) OR x <> 0)) AS nonzero FROM doc_tok)
SELECT count(nullif(active, false)) AS active_vectors, round(min(CASE WHEN active THEN n END), 5) AS least_norm, round(max(CASE WHEN active THEN n END), 5) AS greatest_norm, round(max(CASE WHEN active THEN abs(n - 1) END), 5) AS greatest_error, count(nullif(NOT active AND nonzero > 0, false)) AS masked_not_zero FROM norms""")
def encoding_health(spark: SparkSession, sf: str) -> DataFrame:
    """Norms of active token vectors and masked ones that aren't zero."""
    mask, n = F.coalesce("mask", F.lit(True)), norm(F.col("emb"))
    return _rounded(_tokens(spark, sf).agg(
        F.count_if(mask).alias("active_vectors"), F.min(F.when(mask, n)).alias("least_norm"), F.max(F.when(mask, n)).alias("greatest_norm"), F.max(F.when(mask, F.abs(n - 1))).alias("greatest_error"),
        F.count_if(~mask & F.exists("emb", lambda x: F.isnan(x) | (x != 0))).alias("masked_not_zero"),
    ), 5)


@query("""SELECT document_id, pos, pos < 3 AS active FROM doc_tok""")
def prefix_masks(spark: SparkSession, sf: str) -> DataFrame:
    """Masks with the first three positions active."""
    return _tokens(spark, sf).select("document_id", "pos", maxsim.prefix_mask("pos", 3).alias("active"))


# ---- Subsets, hashes, prompts, digests ------------------------------------------------------------------------


def _selection(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Subsets of all tasks, of the queries and pages that each specification asks for; a task with fewer gives all it has."""
    pages = table(spark, sf, "corpus").select("task", F.col("`corpus-id`").cast("string").alias("document_id"))
    asked = table(spark, sf, "queries").where(F.trim("query") != "").select("task", F.col("`query-id`").cast("string").alias("query_id"))
    return subset.select_subsets(pages, asked, _judged(spark, sf), subset.selections_of(table(spark, sf, "selection_specs")), strict=False)


_SUBSET = f"""WITH {_JUDGED},
inside AS (SELECT s.task, s.salt, s.documents_per_task, j.query_id, j.document_id FROM selection_specs s JOIN corpus c ON c.task = s.task JOIN judged j ON j.document_id = CAST(c."corpus-id" AS VARCHAR)),
asked AS (SELECT DISTINCT s.task, s.salt, s.queries_per_task, CAST(q."query-id" AS VARCHAR) AS query_id FROM selection_specs s JOIN queries q ON q.task = s.task WHERE trim(q.query) <> '' AND (s.task, CAST(q."query-id" AS VARCHAR)) IN (SELECT (task, query_id) FROM inside)),
chosen AS (SELECT task, query_id, hash FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY hash, query_id) AS n FROM (SELECT *, sha256(salt || chr(0) || 'query' || chr(0) || query_id) AS hash FROM asked)) WHERE n <= queries_per_task),
pages AS (SELECT s.task, s.salt, s.documents_per_task AS capacity, CAST(c."corpus-id" AS VARCHAR) AS document_id, sha256(s.salt || chr(0) || 'document' || chr(0) || CAST(c."corpus-id" AS VARCHAR)) AS hash FROM selection_specs s JOIN corpus c ON c.task = s.task),
required AS (SELECT DISTINCT i.task, i.document_id FROM inside i JOIN chosen USING (task, query_id)),
marked AS (SELECT p.*, (p.task, p.document_id) IN (SELECT (task, document_id) FROM required) AS positive FROM pages p)"""


@query(f"{_SUBSET} SELECT task, query_id, hash FROM chosen")
def subset_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The first queries by salted hash of each task."""
    return _selection(spark, sf)[0]


@query(f"{_SUBSET} SELECT task, document_id, hash, positive FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY positive DESC, hash, document_id) AS n FROM marked) WHERE n <= capacity")
def subset_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Their positives, filled up with distractors by hash."""
    return _selection(spark, sf)[1]


@query(f"""{_SUBSET}, first AS (SELECT task, document_id, hash, positive FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY positive DESC, hash, document_id) AS n FROM marked) WHERE n <= capacity)
SELECT f.task, f.document_id, f.positive, sha256(c.image.bytes) AS sha256, CASE WHEN len(hex(c.image.bytes)) >= 48 AND starts_with(hex(c.image.bytes), '89504E470D0A1A0A0000000D49484452') THEN CAST('0x' || substr(hex(c.image.bytes), 33, 8) AS BIGINT) END AS width
FROM first f JOIN corpus c ON c.task = f.task AND CAST(c."corpus-id" AS VARCHAR) = f.document_id""")
def subset_images(spark: SparkSession, sf: str) -> DataFrame:
    """The selected pages with the digests of their images and the widths that their headers give."""
    pages = table(spark, sf, "corpus").select("task", F.col("`corpus-id`").cast("string").alias("document_id"), F.col("image.bytes").alias("bytes"))
    asked = table(spark, sf, "queries").where(F.trim("query") != "").select("task", F.col("`query-id`").cast("string").alias("query_id"))
    found = load_subset(pages, asked, _judged(spark, sf), subset.selections_of(table(spark, sf, "selection_specs")), strict=False)
    return found.pages.select("task", "document_id", "positive", "sha256", "width")


@query("SELECT CAST(doc_id AS VARCHAR) AS document_id, sha256('stable' || chr(0) || 'document' || chr(0) || CAST(doc_id AS VARCHAR)) AS hash FROM documents")
def hash_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Salted digests of all documents."""
    return _pages(spark, sf).select("document_id", subset.hash_rank("stable", "document", "document_id").alias("hash"))


@query("""SELECT candidate, workload, trial, CAST(row_number() OVER (PARTITION BY workload, trial ORDER BY sha256('7' || chr(0) || workload || chr(0) || trial || chr(0) || candidate), candidate) AS INTEGER) AS place
FROM (SELECT DISTINCT event_type AS candidate, CAST(user_id % 4 AS VARCHAR) AS workload FROM events), (SELECT unnest(range(0, 3)) AS trial)""")
def trial_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Reproducible shuffles of the candidates of each workload and trial."""
    from pyspark.sql import Window

    pairs = table(spark, sf, "events").select(F.col("event_type").alias("candidate"), (F.col("user_id") % 4).cast("string").alias("workload")).distinct()
    trials = pairs.withColumn("trial", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))))
    order = Window.partitionBy("workload", "trial").orderBy(subset.trial_order("7", F.col("workload"), F.col("trial"), F.col("candidate")), "candidate")
    return trials.withColumn("place", F.row_number().over(order))


@query("""SELECT DISTINCT event_type, CAST(CAST('0x' || substr(sha256('17' || chr(0) || event_type), 1, 16) AS UBIGINT)::HUGEINT % 9223372036854775807 AS BIGINT) AS seed FROM events""")
def workload_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """A stable seed for each workload."""
    return table(spark, sf, "events").select("event_type").distinct().withColumn("seed", subset.stable_seed(F.concat_ws("\0", F.lit("17"), F.col("event_type"))))


@query(rf"""SELECT "query-id", CASE WHEN regexp_matches(query, '[^{_SPACE}]') AND NOT contains(query, '<unused0>') THEN 'Question: ' || query || repeat('<unused0>', 5) END AS prompt FROM queries""")
def query_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts of all queries; null where one can't be made."""
    return table(spark, sf, "queries").select("query-id", prompt(F.col("query")).alias("prompt"))


@query("""SELECT sha256(CASE WHEN "query-id" IS NULL THEN 'n' ELSE 'v' || "query-id" END || chr(0) || CASE WHEN query IS NULL THEN 'n' ELSE 'v' || query END) AS digest FROM queries""")
def row_digests(spark: SparkSession, sf: str) -> DataFrame:
    """A digest of every query row, for comparing tables whatever their order."""
    return fingerprints.row_digests(table(spark, sf, "queries"), "query-id", "query")


# ---- Samples -------------------------------------------------------------------------------------------------

_SAMPLES = "samples AS (SELECT event_type AS candidate, user_id % 4 AS workload, value AS latency_ms, user_id % 2 AS kind FROM events WHERE value > 0)"
_P50 = f"{_SAMPLES}, p50 AS (SELECT workload, candidate, quantile_cont(latency_ms, 0.5) AS p50, sum(latency_ms) AS total FROM samples GROUP BY ALL)"


@query(f"""WITH {_SAMPLES} SELECT candidate, count(*) AS samples, round(min(latency_ms), 4) AS minimum, round(avg(latency_ms), 4) AS mean, round(stddev_pop(latency_ms), 4) AS standard_deviation, round(quantile_cont(latency_ms, 0.5), 4) AS p50, round(quantile_cont(latency_ms, 0.95), 4) AS p95, round(max(latency_ms), 4) AS maximum,
  round(count(*) * 10.0::DOUBLE / (sum(latency_ms) / 1000), 4) AS documents_per_second, round(avg(10.0::DOUBLE / (latency_ms / 1000)), 4) AS documents_per_second_mean, round(quantile_cont(10.0::DOUBLE / (latency_ms / 1000), 0.5), 4) AS documents_per_second_p50,
  round(count(*) * 20.0::DOUBLE / (sum(latency_ms) / 1000), 4) AS pairs_per_second, round(avg(20.0::DOUBLE / (latency_ms / 1000)), 4) AS pairs_per_second_mean, round(quantile_cont(20.0::DOUBLE / (latency_ms / 1000), 0.5), 4) AS pairs_per_second_p50 FROM samples GROUP BY candidate""")
def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Latency figures and throughputs of every candidate."""
    return _rounded(samples.latency_summary(_samples(spark, sf), "latency_ms", 10, 20, ("candidate",)), 4)


@query(f"WITH {_P50} SELECT workload, arg_min(candidate, (p50, candidate)) AS winner, round(min(p50), 6) AS winner_p50 FROM p50 GROUP BY workload")
def workload_winners(spark: SparkSession, sf: str) -> DataFrame:
    """The fastest candidate of each workload."""
    return _rounded(samples.workload_winners(_samples(spark, sf)))


@query(f"""WITH {_P50}, relative AS (SELECT *, p50 / min(p50) OVER (PARTITION BY workload) AS relative FROM p50),
rolled AS (SELECT candidate, quantile_cont(relative, 0.5) AS median_relative_p50, avg(relative) AS mean_relative_p50, sum(total) AS total_ms, count(*) AS workloads, count(*) = (SELECT count(DISTINCT workload) FROM p50) AS eligible FROM relative GROUP BY candidate)
SELECT candidate, round(median_relative_p50, 6) AS median_relative_p50, round(mean_relative_p50, 6) AS mean_relative_p50, round(total_ms, 4) AS total_ms, workloads, eligible,
  CAST(row_number() OVER (ORDER BY eligible DESC, CASE WHEN eligible THEN median_relative_p50 END, CASE WHEN eligible THEN total_ms END, candidate) AS INTEGER) AS place FROM rolled""")
def candidate_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates in order of relative latency."""
    return _rounded(samples.candidate_ranking(_samples(spark, sf))).withColumn("total_ms", F.round("total_ms", 4))


@query(f"WITH {_SAMPLES} SELECT candidate, kind, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(sum(latency_ms), 4) AS total, count(*) AS samples, CAST(grouping(kind) AS TINYINT) AS overall FROM samples GROUP BY GROUPING SETS ((candidate), (candidate, kind))")
def candidate_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Pooled figures of candidates, over all and by kind."""
    return _rounded(samples.candidate_rollup(_samples(spark, sf), "kind")).withColumn("total", F.round("total", 4))


@query(f"WITH {_P50} SELECT round(exp(avg(ln(slow / p50))), 6) AS geometric_mean_speedup, count(nullif(slow > p50, false)) AS wins, count(*) AS comparisons FROM p50 JOIN (SELECT workload, max(p50) AS slow FROM p50 GROUP BY workload) USING (workload)")
def speedups(spark: SparkSession, sf: str) -> DataFrame:
    """Geometric mean speedup over the slowest candidate of each workload, and wins."""
    p50 = samples.workload_p50(_samples(spark, sf))
    both = p50.join(p50.groupBy("workload").agg(F.max("p50").alias("slow")), "workload")
    return both.agg(F.round(geometric_mean(F.col("slow") / F.col("p50")), 6).alias("geometric_mean_speedup"), F.count_if(F.col("slow") > F.col("p50")).alias("wins"), F.count(F.lit(1)).alias("comparisons"))


@query(rf"""WITH n AS (SELECT len(regexp_extract_all(text, '[^{_SPACE}]+')) AS n FROM documents WHERE text IS NOT NULL)
SELECT count(*) AS count, CAST(min(n) AS INTEGER) AS minimum, quantile_cont(n, 0.5) AS p50, round(quantile_cont(n, 0.95), 6) AS p95, CAST(max(n) AS INTEGER) AS maximum, count(nullif(n > 512, false)) AS count_exceeding_limit, round(count(nullif(n > 512, false)) / count(*)::DOUBLE, 6) AS fraction_exceeding_limit FROM n WHERE n > 0""")
def length_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Word counts of all documents against a limit of 512."""
    return _rounded(samples.length_summary(_pages(spark, sf).where("text is not null").select(F.size(words(F.col("text"))).alias("n")), "n", 512))
