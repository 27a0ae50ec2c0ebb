"""Feature engineering: z-scores, one-hot columns, incidence vectors, tf-idf,
measurement triples, PCA / SVD.

Estimator-style operators (z-score, one-hot) fit a bounded set of statistics
(two numbers per column, the level list of a categorical) with one aggregate
and then transform row-wise with literals, like Spark ML's scalers: no join and
no window over all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A categorical with more levels than this is refused by ``one_hot``.
MAX_LEVELS = 1000


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.fill(0, subset=list(cols))


def zscore_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std of each column (one aggregate, a bounded result)."""
    row = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"m_{i}"], row[f"s_{i}"]) for i, c in enumerate(cols)}


def zscore(df: DataFrame, cols: Sequence[str], stats: dict | None = None, prefix: str = "") -> DataFrame:
    """``(x - mean) / std_pop``; a constant column becomes 0.  Missing values are
    filled with 0 before fitting and scaling."""
    df = fill_zero(df, cols)
    stats = stats or zscore_stats(df, cols)
    out = df
    for c in cols:
        m, s = stats[c]
        m = 0.0 if m is None else m
        z = (F.col(c) - F.lit(m)) / F.lit(s) if s else F.lit(0.0)
        out = out.withColumn(prefix + c, z.cast("double"))
    return out


def one_hot_levels(df: DataFrame, col: str, max_levels: int = MAX_LEVELS) -> list:
    levels = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col).limit(max_levels + 1).collect()]
    if len(levels) > max_levels:
        raise ValueError(f"{col} has more than {max_levels} levels")
    return levels


def one_hot(df: DataFrame, cols: Sequence[str], drop_first: bool = True, levels: dict | None = None,
            drop_source: bool = True) -> DataFrame:
    """0/1 column ``<col>_<level>`` per level in sorted order; the first level is
    dropped when ``drop_first`` (the dummy-coding rule).  Null rows get all zeros."""
    out = df
    for c in cols:
        lv = (levels or {}).get(c) or one_hot_levels(df, c)
        for v in (lv[1:] if drop_first else lv):
            out = out.withColumn(f"{c}_{v}", F.coalesce(F.col(c) == F.lit(v), F.lit(False)).cast("int"))
        if drop_source:
            out = out.drop(c)
    return out


def measurement_triples(long_df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Per key: ``<c>_min``, ``<c>_mean``, ``<c>_max`` of each measurement column."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"{c}_min"), F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max")]
    return long_df.groupBy(key).agg(*aggs)


def incidence_long(df: DataFrame, key: str, array_col: str, item: str = "item") -> DataFrame:
    """Binary incidence in long form: one row (key, item) per present item."""
    return df.select(key, F.explode(F.array_distinct(array_col)).alias(item)).distinct()


def vocab_size(df: DataFrame, array_col: str) -> int:
    """Distinct items: ``CountVectorizer`` drops the rarest beyond its ``vocabSize`` (262,144 by default)."""
    return max(1, df.select(F.explode(array_col).alias("item")).distinct().count())


def incidence_vectors(df: DataFrame, array_col: str, out: str = "bow", min_df: float = 1.0):
    """Binary bag-of-items vectors (sparse) with Spark ML ``CountVectorizer``.
    Returns (transformed frame, vocabulary)."""
    from pyspark.ml.feature import CountVectorizer
    model = CountVectorizer(inputCol=array_col, outputCol=out, binary=True, minDF=min_df, vocabSize=vocab_size(df, array_col)).fit(df)
    return model.transform(df), model.vocabulary


def tfidf(df: DataFrame, array_col: str, out: str = "tfidf", smooth_plus_one: bool = True) -> DataFrame:
    """tf-idf with the smoothed idf ``ln((1+n)/(1+df)) + 1`` (Spark's IDF omits the +1,
    added here) and l2 row normalisation."""
    from pyspark.ml.feature import CountVectorizer, IDF, Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array
    cv = CountVectorizer(inputCol=array_col, outputCol="_tf", vocabSize=vocab_size(df, array_col)).fit(df)
    tf = cv.transform(df)
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(tf)
    x = idf.transform(tf)
    if smooth_plus_one:
        # tf * (idf + 1) = tf*idf + tf
        x = x.withColumn("_idf", array_to_vector(F.zip_with(vector_to_array("_idf"), vector_to_array("_tf"),
                                                            lambda a, b: a + b)))
    x = Normalizer(inputCol="_idf", outputCol=out, p=2.0).transform(x)
    return x.drop("_tf", "_idf")


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def pca(df: DataFrame, k: int, input_col: str = "features", out: str = "pca", center: bool = True):
    """PCA to ``k`` components; centred first so projections match the usual definition.
    Returns (projected frame, explained variance list)."""
    from pyspark.ml.feature import PCA, StandardScaler
    src = df
    if center:
        src = StandardScaler(inputCol=input_col, outputCol="_c", withMean=True, withStd=False).fit(df).transform(df)
        input_col = "_c"
    model = PCA(k=k, inputCol=input_col, outputCol=out).fit(src)
    return model.transform(src).drop("_c"), list(model.explainedVariance.toArray())


def components_below_one(explained: Sequence[float]) -> int:
    """Index (0-based) of the last component whose cumulative explained ratio is
    still below 1 (the component-count rule of the original PCA step)."""
    cum, last = 0.0, 0
    for i, v in enumerate(explained):
        cum += v
        if cum < 1:
            last = i
    return last


def truncated_svd(df: DataFrame, k: int, input_col: str = "features"):
    """Rank-``k`` SVD of the row matrix (distributed Gramian), projection ``X V``.
    Returns (projected frame, singular values)."""
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.ml.functions import vector_to_array
    from pyspark.mllib.linalg import Vectors as MV
    rows = df.select(input_col).rdd.map(lambda r: MV.dense(r[0].toArray()))
    svd = RowMatrix(rows).computeSVD(k, computeU=False)
    v = svd.V.toArray()   # d x k, bounded by the feature width
    arr = vector_to_array(input_col)
    proj = [F.aggregate(F.zip_with(arr, F.array(*[F.lit(float(x)) for x in v[:, j]]), lambda a, b: a * b),
                        F.lit(0.0), lambda acc, x: acc + x) for j in range(v.shape[1])]   # a lower rank gives fewer than k
    return df.withColumn("svd", F.array(*proj)), list(svd.s.toArray())


def explained_ratio(projected: DataFrame, width: int, k: int, input_col: str = "features", out: str = "svd") -> float:
    """Share of the columns' total variance that the ``k`` projected columns hold."""
    from pyspark.ml.functions import vector_to_array
    x = projected.select(vector_to_array(input_col).alias("x"), F.col(out).alias("p"))
    row = x.agg(*[F.var_pop(F.col("p")[j]) for j in range(k)], *[F.var_pop(F.col("x")[j]) for j in range(width)]).first()
    total = sum(v or 0.0 for v in row[k:])
    return sum(v or 0.0 for v in row[:k]) / total if total else 0.0
