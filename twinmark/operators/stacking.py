"""Feature assembly and out-of-fold stacking with pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .sampling import kfold


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    """M9: selected columns into one vector (missing values become 0)."""
    filled = df.na.fill(0.0, subset=features)
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(filled)


def out_of_fold_scores(train: DataFrame, test: DataFrame, key: str, features: list[str], label: str = "label",
                       n_splits: int = 5, seed: int = 123, max_iter: int = 50) -> DataFrame:
    """For each fold, fit on the other folds and score the fold and the test rows.

    Returns (key, split, score): one out-of-fold score per training row, and for test rows the
    mean of the fold models' scores (G9).  The five fits are distributed jobs; the loop only
    sequences them.
    """
    tr = kfold(train, key, n_splits, seed).withColumn(label, F.col(label).cast("double"))
    pipe = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="keep"),
                            StandardScaler(inputCol="_raw", outputCol="_x"),
                            LogisticRegression(featuresCol="_x", labelCol=label, maxIter=max_iter,
                                               probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y")])
    # the fits pass over the data many times: cut the feature lineage once (reliable checkpoint)
    tr = cut_lineage(tr.na.fill(0.0, subset=features))
    te = cut_lineage(test.na.fill(0.0, subset=features))
    oof, tests = [], []
    for i in range(n_splits):
        model = pipe.fit(tr.where(F.col("fold") != i))
        prob = lambda d: vector_to_array(F.col("_p"))[1]
        oof.append(model.transform(tr.where(F.col("fold") == i)).select(key, prob(None).alias("score")))
        tests.append(model.transform(te).select(key, prob(None).alias("score")))
    o = oof[0]
    for d in oof[1:]:
        o = o.unionByName(d)
    t = tests[0]
    for d in tests[1:]:
        t = t.unionByName(d)
    t = t.groupBy(key).agg(F.avg("score").alias("score"))
    return o.withColumn("split", F.lit("train")).unionByName(t.withColumn("split", F.lit("test")))
