"""Hybrid document search for a batch of queries: BM25, exact vector search, rank fusion."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ledgerlake.functions.hashing import fingerprint
from ledgerlake.functions.text import tokens
from ledgerlake.operators.ranking import top_n_per_key
from ledgerlake.session import checkpointed, written

# ---- fixed values: BM25 and fusion constants ----
K1 = 1.2
B = 0.75
RRF_K = 60

#: Query and corpus vectors that one task holds.
QUERY_BLOCK = 2048
CORPUS_BLOCK = 16_384

#: Postings of a block of documents, and (token, document) cells that a task fills at a time.
POSTING_BLOCK = 500_000
STRIP_CELLS = 1 << 21


# Workers get this module's functions with the task; they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# ---- sparse ----


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, tok), once per distinct token of a query."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("tok"))


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, tok, tf, dl) for the tokens in ``vocabulary``, from one read of the documents.

    Every document also gets one row with an empty token, which carries its length for
    the corpus statistics. Tokens outside the vocabulary are dropped before the shuffle,
    and counts are combined inside each map task.
    """
    words = docs.select(
        "doc_id", tokens(F.concat_ws(" ", F.coalesce("title", F.lit("")), "content")).alias("_toks")
    )
    exploded = words.select(
        "doc_id",
        F.size("_toks").cast("long").alias("dl"),
        F.explode(F.concat(F.array(F.lit("")), F.col("_toks"))).alias("tok"),
    )
    kept = vocabulary.select("tok").unionByName(vocabulary.sparkSession.range(1).select(F.lit("").alias("tok")))
    return (
        exploded.join(kept.distinct(), "tok", "left_semi")
        .groupBy("doc_id", "tok")
        .agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))
    )


def _best_in_block(k: int):
    """A cogrouped function: each query's ``k`` best documents of every strip of a block of documents."""

    def run(docs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if docs.empty or queries.empty:
            return pd.DataFrame({"query_id": np.empty(0, dtype=object), "doc_id": np.empty(0, dtype=object), "total": np.empty(0, dtype=np.int64)})
        docs = docs.sort_values("doc_id", na_position="first")  # so that the first of equal scores has the least name
        ids, asked = docs["doc_id"].to_numpy(), queries["query_id"].to_numpy()
        vocabulary, at = np.unique(np.concatenate(queries["terms"].to_list()), return_inverse=True)
        rows = np.split(at, np.cumsum(queries["terms"].map(len).to_numpy())[:-1])
        doc = np.repeat(np.arange(len(ids)), docs["terms"].map(len).to_numpy())
        term, weight = np.concatenate(docs["terms"].to_list()), np.concatenate(docs["weights"].to_list())
        spot = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
        used = vocabulary[spot] == term
        doc, spot, weight = doc[used], spot[used], weight[used]
        width = max(1, STRIP_CELLS // len(vocabulary))
        found = []
        for start in range(0, len(ids), width):
            low, high = np.searchsorted(doc, (start, start + width))
            cells = np.full((len(vocabulary), min(width, len(ids) - start)), -1, dtype=np.int64)
            cells[spot[low:high], doc[low:high] - start] = weight[low:high]
            # A weight may be as little as 0, so a common token shows in a cell that was filled.
            filled = cells >= 0
            cells[~filled] = 0
            bare = bool(np.any(weight[low:high] == 0))
            for query, its in enumerate(rows):
                total = cells[its].sum(axis=0)
                here = np.flatnonzero(filled[its].any(axis=0) if bare else total)
                if len(here) > k:
                    here = here[total[here] >= np.partition(total[here], len(here) - k)[len(here) - k]]
                here = here[np.argsort(-total[here], kind="stable")[:k]]
                found.append((query, start + here, total[here]))
        lengths = [len(h) for _, h, _ in found]
        return pd.DataFrame({
            "query_id": asked[np.repeat([q for q, _, _ in found], lengths)],
            "doc_id": ids[np.concatenate([h for _, h, _ in found])],
            "total": np.concatenate([t for _, _, t in found]),
        })

    return run


def bm25(
    queries: DataFrame, docs: DataFrame, k: int, query_block: int = QUERY_BLOCK, posting_block: int = POSTING_BLOCK
) -> DataFrame:
    """(query_id, doc_id, score, rnk): the best ``k`` scoring documents of every query.

    ``queries`` has query_id and query; ``docs`` has doc_id, title and content. Documents
    sharing no token with a query get no row. Term scores are summed as whole billionths,
    so equal documents tie exactly whatever order the tasks finish in. A term's score in a document
    is the same for all queries, so it is worked out once; then blocks of queries meet blocks of
    documents as in :func:`nearest`, and only a block's best ``k`` per query are shuffled.
    """
    wanted = checkpointed(query_tokens(queries))  # read for the vocabulary and for the queries' terms
    # Postings feed the statistics and the scores; they are far smaller than the corpus.
    found = written(postings(docs, wanted), "postings")
    stats = found.agg(
        F.count_if(F.col("tok") == "").alias("n_docs"), F.avg(F.when(F.col("tok") == "", F.col("dl"))).alias("avgdl"), F.count(F.lit(1)).alias("n")
    )
    n_docs, avgdl, n_postings = stats.first()
    if not n_docs or not avgdl:
        return wanted.sparkSession.createDataFrame(
            [], "query_id string, doc_id string, score double, rnk int"
        )
    terms = found.where(F.col("tok") != "")
    idf = F.ln(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    vocabulary = written(
        terms.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).select("tok", idf.alias("idf"), F.monotonically_increasing_id().alias("term")),
        "vocabulary",
    )
    saturation = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl))
    term_score = F.col("idf") * (F.col("tf") * (K1 + 1)) / saturation
    entry = F.struct("term", F.round(term_score * 1e9).cast("long").alias("weight"))
    groups = max(1, -(-wanted.agg(F.count_distinct("query_id")).first()[0] // query_block))
    blocks = max(1, -(-n_postings // posting_block))
    weighed = terms.join(vocabulary, "tok").groupBy("doc_id").agg(F.collect_list(entry).alias("_e")).select(
        "doc_id", F.col("_e.term").alias("terms"), F.col("_e.weight").alias("weights"),
        F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"),
    )
    asked = wanted.join(vocabulary, "tok").groupBy("query_id").agg(F.collect_list("term").alias("terms")).select(
        "query_id", "terms", F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("group")
    )
    left = weighed.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    right = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    schema = StructType([wanted.schema["query_id"], docs.schema["doc_id"], StructField("total", LongType())])
    out = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInPandas(_best_in_block(k), schema)
    scored = out.select("query_id", "doc_id", (F.col("total") / 1e9).alias("score"))
    best = top_n_per_key(scored, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)
    return best.withColumnRenamed("rn", "rnk")


# ---- dense ----


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _best(query: np.ndarray, distance: np.ndarray, name: np.ndarray, k: int):
    """The ``k`` least (distance, name) of every query, from parallel arrays."""
    order = np.lexsort((name, distance, query))
    query, distance, name = query[order], distance[order], name[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    keep = place < k
    return query[keep], distance[keep], name[keep]


def _nearest_in_block(k: int):
    """A cogrouped function: each query's ``k`` nearest rows of one block of the corpus."""

    def run(corpus: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if corpus.empty or queries.empty:
            return pd.DataFrame({"query_id": np.empty(0, dtype=object), "doc_id": np.empty(0, dtype=object), "distance": np.empty(0)})
        ids, asked = corpus["doc_id"].to_numpy().astype(str), queries["query_id"].to_numpy().astype(str)
        rows = _unit(np.stack(corpus["embedding"].to_numpy()).astype(np.float64))
        wanted = _unit(np.stack(queries["embedding"].to_numpy()).astype(np.float64))
        found = []
        for start in range(0, len(asked), 256):
            distances = np.round(1.0 - rows @ wanted[start : start + 256].T, 10)
            # Ties at the limit stay in: the name decides among them.
            reach = np.partition(distances, k - 1, axis=0)[k - 1] if len(ids) > k else np.inf
            at, query = np.nonzero(distances <= reach)
            query, distance, name = _best(query + start, distances[at, query], ids[at], k)
            found.append(pd.DataFrame({"query_id": asked[query], "doc_id": name, "distance": distance}))
        return pd.concat(found)

    return run


def nearest(
    query_vectors: DataFrame, vectors: DataFrame, k: int, query_block: int = QUERY_BLOCK, corpus_block: int = CORPUS_BLOCK
) -> DataFrame:
    """(query_id, doc_id, distance, rnk): the exact ``k`` nearest vectors by cosine distance.

    ``query_vectors`` has one row per query: query_id and embedding; ``vectors`` has doc_id
    and embedding. Both are dealt into blocks by hash and every block of queries meets every
    block of the corpus in a task of its own, which sends its best ``k`` per query on. A task
    holds two blocks and the driver only their number, however many queries there are.
    """
    queries = query_vectors.select("query_id", "embedding").dropDuplicates(["query_id"])
    groups = max(1, -(-queries.count() // query_block))
    blocks = max(1, -(-vectors.count() // corpus_block))
    dealt = vectors.select(F.col("doc_id").cast("string").alias("doc_id"), "embedding").withColumn(
        "block", F.pmod(fingerprint(F.col("doc_id")), F.lit(blocks))
    )
    asked = queries.withColumn("group", F.pmod(fingerprint(F.col("query_id")), F.lit(groups)))
    left = dealt.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    right = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    out = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInPandas(
        _nearest_in_block(k), "query_id string, doc_id string, distance double"
    )
    best = top_n_per_key(out, ["query_id"], [F.asc("distance"), F.asc("doc_id")], k)
    return best.withColumnRenamed("rn", "rnk")


# ---- fusion ----


def fuse(dense: DataFrame, sparse: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion per query: (query_id, doc_id, rrf, in_dense, in_sparse, rnk).

    Both inputs need query_id, doc_id and rnk; either may be empty.
    """
    ranked = dense.select("query_id", "doc_id", "rnk", F.lit("dense").alias("src")).unionByName(
        sparse.select("query_id", "doc_id", "rnk", F.lit("sparse").alias("src"))
    )
    fused = ranked.groupBy("query_id", "doc_id").agg(
        F.sum(1 / (RRF_K + F.col("rnk"))).alias("rrf"),
        F.bool_or(F.col("src") == "dense").alias("in_dense"),
        F.bool_or(F.col("src") == "sparse").alias("in_sparse"),
    )
    best = top_n_per_key(fused, ["query_id"], [F.desc("rrf"), F.asc("doc_id")], k)
    return best.withColumnRenamed("rn", "rnk").withColumn(
        "retriever", retriever(F.col("in_dense"), F.col("in_sparse"))
    )


def retriever(in_dense: Column, in_sparse: Column) -> Column:
    """Which retriever found a document: hybrid, dense or sparse."""
    return F.when(in_dense & in_sparse, "hybrid").when(in_dense, "dense").otherwise("sparse")


def hybrid_search(
    queries: DataFrame, query_vectors: DataFrame, chunks: DataFrame, vectors: DataFrame, k_each: int = 8, k: int = 8
) -> DataFrame:
    """Fused candidates of every query with the chunk's own columns.

    ``chunks`` has doc_id, title, category and content; ``vectors`` has doc_id and embedding of
    those embedded so far. The two meet in the fused rows only: BM25 reads no vector, and
    vectors without a chunk are left out before the search. A query without token overlap still
    gets its dense results, and the other way round.
    """
    embedded = vectors.where(F.col("embedding").isNotNull()).join(chunks.select("doc_id"), "doc_id", "left_semi")
    dense = nearest(query_vectors, embedded, k_each)
    sparse = bm25(queries, chunks, k_each)
    fused = fuse(dense, sparse, k)
    return fused.join(chunks.select("doc_id", "title", "category", "content"), "doc_id")


# ---- reranking from a table of replies ----


def reply_order(reply: Column, n: Column) -> Column:
    """0-based positions named in a reply: its numbers less one, in range, first mention kept."""
    named = F.transform(
        F.regexp_extract_all(F.coalesce(reply, F.lit("")), F.lit("[0-9]+"), F.lit(0)),
        lambda t: t.try_cast("long") - 1,
    )
    return F.array_distinct(F.filter(named, lambda i: i.isNotNull() & (i >= 0) & (i < n)))


def rerank(candidates: DataFrame, replies: DataFrame) -> DataFrame:
    """Candidates (query_id, doc_id, rnk) in the order of each query's reply, as ``final_rank``.

    Candidates a reply leaves out follow in fused order; an empty reply changes nothing.
    """
    counted = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    orders = counted.join(replies, "query_id", "left").select(
        "query_id", reply_order(F.col("reply"), F.col("_n")).alias("_order")
    )
    place = F.array_position("_order", F.col("rnk").cast("long") - 1)
    # A left-out candidate follows the named ones, behind the left-out ones ranked above it.
    named_above = F.size(F.filter("_order", lambda i: i < F.col("rnk") - 1))
    left_out = F.size("_order") + F.col("rnk") - named_above
    return (
        candidates.join(orders, "query_id")
        .withColumn("final_rank", F.when(place > 0, place).otherwise(left_out).cast("long"))
        .drop("_order")
    )


# ---- corpus upkeep ----


def attach_vectors(raw: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with their vector; chunks not embedded yet keep a null vector."""
    return raw.join(vectors.select("doc_id", "embedding"), "doc_id", "left")


def needs_embedding(chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """New or changed chunks: no row of ``embedded`` (doc_id, content_hash) has their hash."""
    hashed = chunks.withColumn("content_hash", F.sha2("content", 256))
    return hashed.join(embedded.select("doc_id", "content_hash"), ["doc_id", "content_hash"], "left_anti")
