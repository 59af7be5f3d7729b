"""Encoders over many columns at once: truncated SVD, TF-IDF of n-grams, cluster distances."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import CountVectorizer, NGram, RegexTokenizer, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from foldwise.encoders.base import Fitted
from foldwise.encoders.sparse import per_row, row_products, singular_vectors, total_variance

VECTOR = "_vector"


def as_vector(df: DataFrame, source: str | Sequence[str], out: str = VECTOR) -> DataFrame:
    """One vector column from numeric columns, or the named vector column under ``out``."""
    if isinstance(source, str):
        return df.withColumn(out, F.col(source))
    typed = df.withColumns({f"_d_{c}": F.col(c).cast("double") for c in source})
    return VectorAssembler(inputCols=[f"_d_{c}" for c in source], outputCol=out, handleInvalid="error").transform(typed).drop(
        *[f"_d_{c}" for c in source]
    )


class SvdModel(Fitted):
    @property
    def loadings(self) -> np.ndarray:
        return np.array(self.params["loadings"])

    def transform(self, df: DataFrame) -> DataFrame:
        p = self.params
        df = self._scored(df)
        return df.withColumns({o: F.col("_scores")[i] for i, o in enumerate(p["outs"])}).drop("_scores", VECTOR)

    def _scored(self, df: DataFrame) -> DataFrame:
        """Adds the vector and, as one array, its product with the loadings."""
        loadings = self.loadings
        df = as_vector(df, self.params["source"])
        return df.withColumn("_scores", per_row(df, F.col(VECTOR), lambda at, value, n: row_products(at, value, n, loadings)))

    def explained_ratio(self, df: DataFrame) -> float:
        """Variance of the scores over the total variance of the input."""
        scored = self._scored(df).select(F.posexplode("_scores").alias("place", "score"))
        part = scored.groupBy("place").agg(F.var_pop("score").alias("v")).agg(F.sum("v")).first()[0]
        return part / total_variance(as_vector(df, self.params["source"]), VECTOR)


class TruncatedSvd:
    """The ``k`` leading right singular vectors without centring; scores are ``X V``.

    The sign of each component makes its largest loading positive. Rows stay sparse; there are always
    ``min(k, width)`` components, and those beyond the rank score zero. ``params["residual"]`` is the largest
    ``|G v - s^2 v|`` over the largest ``s^2``. A null vector is left out of the fit and gets null scores.
    """

    def __init__(self, source: str | Sequence[str], k: int, prefix: str = "svd"):
        self.source, self.k, self.prefix = source if isinstance(source, str) else list(source), k, prefix

    def fit(self, df: DataFrame) -> SvdModel:
        vectors = as_vector(df, self.source).select(VECTOR)
        v, singular, residual = singular_vectors(vectors, VECTOR, self.k)
        peak = v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])]
        v = v * np.where(peak < 0, -1.0, 1.0)
        outs = [f"{self.prefix}{i}" for i in range(v.shape[1])]
        params = {
            "source": self.source,
            "outs": outs,
            "loadings": v.tolist(),
            "singular": singular.tolist(),
            "residual": residual,
        }
        return SvdModel(params)


class TfidfModel(Fitted):
    """Holds the CountVectorizer vocabulary and the smoothed idf."""

    def _grams(self, df: DataFrame) -> DataFrame:
        return with_grams(df, self.params["col"], self.params["sizes"])

    def transform(self, df: DataFrame, out: str = "tfidf") -> DataFrame:
        """Adds the L2-normalised sparse vector."""
        from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
        from pyspark.ml.linalg import Vectors

        p = self.params
        counts = CountVectorizerModel.from_vocabulary(p["outs"], inputCol="_grams", outputCol="_counts")
        weigh = ElementwiseProduct(scalingVec=Vectors.dense(p["idf"]), inputCol="_counts", outputCol="_weighted")
        normal = Normalizer(p=2.0, inputCol="_weighted", outputCol=out)
        df = normal.transform(weigh.transform(counts.transform(self._grams(df))))
        return df.drop("_grams", "_counts", "_weighted")


def with_grams(df: DataFrame, col: str, sizes: tuple[int, int]) -> DataFrame:
    """Adds ``_grams``: words of at least two characters and their n-grams."""
    words = RegexTokenizer(
        pattern=r"\w\w+", gaps=False, toLowercase=True, minTokenLength=1, inputCol=col, outputCol="_words"
    ).transform(df)
    parts = []
    for n in range(sizes[0], sizes[1] + 1):
        words = NGram(n=n, inputCol="_words", outputCol=f"_g{n}").transform(words)
        parts.append(f"_g{n}")
    return words.withColumn("_grams", F.concat(*parts)).drop("_words", *parts)


class TfidfNgrams:
    """Counts of words and n-grams times ``ln((1+n)/(1+df)) + 1``, each row of length one.

    ``max_terms`` bounds the vector width; the default is above any vocabulary
    of mode words, and a vocabulary beyond it raises an error instead of being cut.
    """

    def __init__(self, col: str, sizes: tuple[int, int] = (1, 2), max_terms: int = 1 << 18):
        self.col, self.sizes, self.max_terms = col, sizes, max_terms

    def fit(self, df: DataFrame) -> TfidfModel:
        grams = with_grams(df, self.col, self.sizes)
        n = grams.count()
        present = grams.select(F.explode(F.array_distinct("_grams")).alias("term"))
        table = present.groupBy("term").agg(F.count(F.lit(1)).alias("df")).limit(self.max_terms + 1).collect()
        if len(table) > self.max_terms:
            raise ValueError(f"more than {self.max_terms} terms; raise max_terms")
        found = sorted((r["term"], r["df"]) for r in table)
        params = {
            "col": self.col,
            "sizes": list(self.sizes),
            "outs": [t for t, _ in found],
            "idf": [float(np.log((1 + n) / (1 + d)) + 1) for _, d in found],
        }
        return TfidfModel(params)


class RbfModel(Fitted):
    def transform(self, df: DataFrame) -> DataFrame:
        p = self.params
        df = as_vector(df, p["source"])
        for k, centres in p["centres"].items():
            df = df.withColumn(f"cluster_rbf_{k}", centre_similarity(df, np.array(centres), p["gamma"]))
        return df.drop(VECTOR)


def centre_similarity(df: DataFrame, centres: np.ndarray, gamma: float) -> Column:
    """``exp(-gamma * distance)`` to every centre, in Arrow batches."""
    norms, flat = (centres**2).sum(axis=1), np.ascontiguousarray(centres.T)

    def similarity(at: np.ndarray, value: np.ndarray, n: np.ndarray) -> np.ndarray:
        own = row_products(np.zeros(len(at), np.int64), value**2, n, np.ones((1, 1)))
        return np.exp(-gamma * np.sqrt(np.maximum(own + norms - 2 * row_products(at, value, n, flat), 0.0)))

    return per_row(df, F.col(VECTOR), similarity)


class ClusterRbf:
    """Similarity to k-means centres for several k; output is one array column per k."""

    # fixed values: the cluster counts, and the rule that gives each its seed
    KS = (25, 50, 75, 100, 200)

    def __init__(self, source: str | Sequence[str], ks: Sequence[int] = KS, gamma: float = 1.0, seed: int | None = None, max_iter: int = 20):
        self.source = source if isinstance(source, str) else list(source)
        self.ks, self.gamma, self.seed, self.max_iter = list(ks), gamma, seed, max_iter

    def fit(self, df: DataFrame) -> RbfModel:
        rows = as_vector(df, self.source).select(VECTOR).persist()
        centres, outs = {}, []
        for k in self.ks:
            seed = 17 * k + 11 if self.seed is None else self.seed
            model = KMeans(k=k, seed=seed, maxIter=self.max_iter, featuresCol=VECTOR).fit(rows)
            found = np.array(model.clusterCenters())
            centres[str(k)] = found.tolist()
            outs += [f"cluster_rbf_{k}_{i}" for i in range(len(found))]
        rows.unpersist()
        return RbfModel({"source": self.source, "outs": outs, "centres": centres, "gamma": self.gamma})
