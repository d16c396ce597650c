"""Lexical retrieval over chunks: TF-IDF cosine, BM25 and their mixture with a floor, pins and top k.

Postings are (chunk_id, term, tf). Only terms of the queries are joined for scores; chunk lengths in vector space
are one aggregate over all postings. Queries are a table (query_id, text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sarafa.functions.strings import ascii_tokens

# ---- fixed values ----
K1, B, BM_WEIGHT, FLOOR, TOP_K = 1.5, 0.75, 0.5, 0.10, 5
# ---- end of fixed values ----


def postings(chunks: DataFrame, id_column: str = "chunk_id", text_column: str = "text") -> DataFrame:
    """(id, term, n, len): term counts of each chunk with its length in tokens. Texts without tokens give none."""
    t = chunks.select(F.col(id_column).alias("id"), ascii_tokens(F.col(text_column)).alias("t")).select("id", F.size("t").alias("len"), F.explode("t").alias("term"))
    return t.groupBy("id", "term", "len").agg(F.count("*").alias("n"))


def document_frequency(post: DataFrame) -> DataFrame:
    """(term, df)."""
    return post.groupBy("term").agg(F.count("*").alias("df"))


def corpus(chunks: DataFrame, text_column: str = "text") -> DataFrame:
    """One row (n_docs, avg_len) over all chunks, empty ones included."""
    return chunks.agg(F.count("*").alias("n_docs"), F.avg(F.size(ascii_tokens(F.col(text_column)))).alias("avg_len"))


def tfidf(chunks: DataFrame, queries: DataFrame, id_column: str = "chunk_id") -> DataFrame:
    """(query_id, id, cosine) of the pairs that share a term."""
    post = postings(chunks, id_column)
    n_docs = corpus(chunks).select("n_docs").scalar()
    weigh = F.log((1 + F.col("n_docs")) / (1 + F.coalesce("df", F.lit(0)))) + 1
    idf = document_frequency(post).withColumn("n_docs", n_docs).select("term", weigh.alias("idf"))
    doc = post.join(idf, "term").select("id", "term", (F.col("n") / F.col("len") * F.col("idf")).alias("w"))
    norm = doc.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    q = postings(queries, "query_id").withColumnRenamed("id", "query_id").join(document_frequency(post), "term", "left").withColumn("n_docs", n_docs)
    qw = q.select("query_id", "term", (F.col("n") / F.col("len") * weigh).alias("qw"))
    qn = qw.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    dot = doc.join(qw, "term").groupBy("query_id", "id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    return dot.join(norm, "id").join(qn, "query_id").select("query_id", "id", (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("cosine"))


def bm25(chunks: DataFrame, queries: DataFrame, id_column: str = "chunk_id") -> DataFrame:
    """(query_id, id, bm25) of the pairs that share a term; a query's terms count once."""
    post = postings(chunks, id_column)
    stats = corpus(chunks).select(F.struct("n_docs", "avg_len")).scalar()
    q = postings(queries, "query_id").select(F.col("id").alias("query_id"), "term")
    idf = document_frequency(post).withColumn("c", stats).select("term", F.log(1 + (F.col("c.n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "c.avg_len")
    hit = post.join(q, "term").join(idf, "term")
    score = F.col("idf") * F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return hit.groupBy("query_id", "id").agg(F.sum(score).alias("bm25"))


def top(scored: DataFrame, score: str, k: int = TOP_K) -> DataFrame:
    """The k best rows of each query, ties by id; Spark limits each task's rows before it shuffles."""
    w = W.partitionBy("query_id").orderBy(F.desc(score), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hybrid(chunks: DataFrame, queries: DataFrame, pinned: DataFrame, k: int = TOP_K, id_column: str = "chunk_id") -> DataFrame:
    """(query_id, id, score, is_pinned, rank): all pinned chunks, without a rank, and the k best others.

    Others must reach the cosine floor; BM25, divided by its greatest among the candidates, re-orders but never
    admits. pinned: (id). A query without candidates gives no row.
    """
    cos, bm = tfidf(chunks, queries, id_column), bm25(chunks, queries, id_column)
    pins = pinned.select("id").distinct().withColumn("is_pinned", F.lit(True))
    every = cos.join(bm, ["query_id", "id"], "left").join(pins, "id", "left").withColumn("is_pinned", F.coalesce("is_pinned", F.lit(False)))
    cand = every.filter(F.col("is_pinned") | (F.col("cosine") >= FLOOR))
    best = cand.groupBy("query_id").agg(F.max("bm25").alias("best"))
    s = cand.join(best, "query_id").withColumn("score", F.col("cosine") + BM_WEIGHT * F.coalesce(F.try_divide("bm25", "best"), F.lit(0.0)))
    # Only the others are ranked, so that Spark limits each task's rows before it shuffles; pins are all kept.
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    names = ["query_id", "id", "score", "is_pinned", "rank"]
    free = s.filter("NOT is_pinned").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return s.filter("is_pinned").withColumn("rank", F.lit(None).cast("int")).select(*names).unionByName(free.select(*names))


def best_over_queries(scored: DataFrame, score: str, k: int = 18) -> DataFrame:
    """(id, score): each chunk's best score over all queries, the k best chunks; ties by id."""
    return scored.groupBy("id").agg(F.max(score).alias(score)).orderBy(F.desc(score), "id").limit(k)
