"""Feature extraction and small fitted models with Spark ML; everything is fitted on training rows only."""

from __future__ import annotations

from pyspark.ml.feature import IDF, PCA, HashingTF, NGram, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.vectors import unit


def pca_projection(df: DataFrame, vector: str, train: Column, k: int) -> tuple[DataFrame, list[float]]:
    """df with ``projection`` (k components, centred by the training mean) and the variance that each component explains; signs are arbitrary."""
    rows = df.withColumn("_t", train)
    n = rows.select(F.size(vector)).first()
    if n is None:
        return df.withColumn("projection", F.array().cast("array<double>")), []
    mean = rows.where("_t").select([F.avg(F.col(vector)[i]).alias(str(i)) for i in range(n[0])]).first()
    centred = rows.withColumn("_v", array_to_vector(F.zip_with(vector, F.array(*[F.lit(float(x or 0)) for x in mean]), lambda x, m: x - m)))
    model = PCA(k=min(k, n[0]), inputCol="_v", outputCol="_p").fit(centred.where("_t"))
    return model.transform(centred).withColumn("projection", vector_to_array("_p")).drop("_v", "_p", "_t"), model.explainedVariance.toArray().tolist()


def tfidf_vectors(docs: DataFrame, dim: int = 256) -> DataFrame:
    """doc_id, v: unit vectors of hashed one- and two-word terms weighted by rarity; empty texts are zero vectors."""
    words = RegexTokenizer(inputCol="text", outputCol="w", pattern="[^a-z0-9]+").transform(docs.withColumn("text", F.coalesce("text", F.lit(""))))
    two = NGram(n=2, inputCol="w", outputCol="w2").transform(words).withColumn("terms", F.concat("w", "w2"))
    tf = HashingTF(numFeatures=dim, inputCol="terms", outputCol="tf").transform(two)
    return IDF(inputCol="tf", outputCol="x").fit(tf).transform(tf).select("doc_id", unit(vector_to_array("x")).alias("v"))
