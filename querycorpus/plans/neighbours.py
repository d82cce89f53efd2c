"""Vector operators on the embeddings and on the sentences of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from querycorpus.functions.scale import scratch_path
from querycorpus.operators import vectors as V
from querycorpus.plans.inputs import table


def _neighbours(spark, sf_dir, **options):
    e = table(spark, sf_dir, "embeddings")
    return V.nearest(e, e, 5, "vec_id", "vec_id", exclude_same=True, **options).select(
        "query_id", "item_id", "rank", F.round("similarity", 6).alias("similarity")
    )


def nearest_vectors(spark, sf_dir):
    return _neighbours(spark, sf_dir)


def nearest_same_label(spark, sf_dir):
    return _neighbours(spark, sf_dir, filters=["label"])


def similar_examples(spark, sf_dir):
    """Examples for every embedding: stored vectors, own row left out, same label only."""
    e = table(spark, sf_dir, "embeddings")
    found = V.similar_examples(e.select("vec_id", "label"), e, 3, "vec_id", same_db="label")
    return found.select("query_id", "item_id", "rank", F.round("similarity", 6).alias("similarity"))


def stored_vectors(spark, sf_dir):
    """Two overlapping batches into one vector table, then the vector of every key and some unknown ones."""
    path = scratch_path(spark, "vectors")
    rows = V.packed(
        table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.struct("label", F.lit("x").alias("mark")).alias("payload")), ["payload"]
    )
    V.store_vectors(rows.where("vec_id % 3 <> 0"), path, "vec_id", "embedding", 64)
    V.store_vectors(rows.where("vec_id % 2 = 0"), path, "vec_id", "embedding", 64, stored_keys="skip")
    stored = V.unpacked(spark.read.parquet(path), {"payload": "label int, mark string"})
    keys = table(spark, sf_dir, "embeddings").select("vec_id")
    found = V.vectors_of(keys, stored, "vec_id").join(stored.select("vec_id", "payload"), "vec_id", "left")
    return found.select("vec_id", F.size("embedding").alias("dims"), "payload.label", F.lit(V.is_filled(spark, path)).alias("filled"))


def encoded_sentences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    items = docs.select("doc_id", F.split("text", r"\.").alias("sentences"))
    encoded = V.encode_items(items, "doc_id", "sentences", dims=16)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    checked = encoded.withColumn("_n", F.round(norm, 4))
    # The places of the vectors count too: each component by its number.
    weighted = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return checked.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("sentences"), F.count(F.when(F.col("_n") == 1, True)).alias("unit"), F.count(F.when(F.col("_n") == 0, True)).alias("empty"),
        F.round(F.sum(weighted), 2).alias("weighted"),
    )


def regrouped_sentences(spark, sf_dir):
    docs = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.split("text", r"\.").alias("s"))
    grouped = V.regrouped(V.encode_items(docs, "id", "s", dims=8), "id")
    return grouped.select("id", F.size("embeddings").alias("n"), F.size(F.try_element_at(F.col("embeddings"), F.lit(1))).alias("dims"))


def reduced_vectors(spark, sf_dir):
    return V.reduced(table(spark, sf_dir, "embeddings"), "embedding", 8).select("vec_id", F.size("embedding").alias("dims"))


QUERIES = {
    f.__name__: f
    for f in [nearest_vectors, nearest_same_label, similar_examples, stored_vectors, encoded_sentences, regrouped_sentences, reduced_vectors]
}


def _knn(k, extra=""):
    return f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id,
          round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS s
        FROM embeddings q, embeddings e WHERE q.vec_id <> e.vec_id {extra})
      SELECT query_id, item_id, CAST(rank AS INT) AS rank, round(s, 6) AS similarity
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM s) WHERE rank <= {k}"""


ORACLES = {
    "nearest_vectors": _knn(5),
    "nearest_same_label": _knn(5, "AND q.label = e.label"),
    "similar_examples": _knn(3, "AND q.label = e.label"),
    "stored_vectors": """SELECT vec_id, CASE WHEN vec_id % 3 <> 0 OR vec_id % 2 = 0 THEN CAST(len(embedding) AS INT) END AS dims,
        CASE WHEN vec_id % 3 <> 0 OR vec_id % 2 = 0 THEN label END AS label, true AS filled FROM embeddings""",
    "encoded_sentences": """WITH s AS (SELECT doc_id, unnest(string_split(text, '.')) AS s, unnest(range(len(string_split(text, '.')))) AS place FROM documents),
        w AS (SELECT doc_id, place, unnest(list_filter(string_split_regex(lower(s), '[^a-z0-9_]+'), lambda x: x <> '')) AS word FROM s),
        c AS (SELECT doc_id, place, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 16 AS k, count(*) AS n FROM w GROUP BY ALL),
        v AS (SELECT doc_id, place, sum((k + 1) * n) / sqrt(sum(n * n)) AS weighted FROM c GROUP BY ALL)
        SELECT doc_id, count(*) AS sentences, count(weighted) AS unit, count(*) - count(weighted) AS empty, round(coalesce(sum(weighted), 0.0), 2) AS weighted
        FROM s LEFT JOIN v USING (doc_id, place) GROUP BY doc_id""",
    "regrouped_sentences": "SELECT conv_id * 1000 + turn AS id, CAST(len(string_split(text, '.')) AS INT) AS n, 8 AS dims FROM conversations",
    "reduced_vectors": "SELECT vec_id, 8 AS dims FROM embeddings",
}
