"""Logistic fits on the panel by Spark's own estimator."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.operators.crosssection import with_date_weight
from phasegrid.operators.inference import score_metrics
from phasegrid.sources.store import stored

def logistic_designs(panel: DataFrame, c: float = 1.0, split: str = "1999-01-01") -> DataFrame:
    """(return_mode, design, brier, log_loss, auc, ...) on later rows of logistic fits to earlier ones: horizon only, spectral, controls, both."""
    out = None
    hs = sorted(r[0] for r in panel.select("horizon").distinct().collect())
    spectral, control = [c for c in panel.columns if c.startswith("psi_")], ["vol20", "range20", "log_dollar_volume20"]
    data = panel.filter(F.col("horizon").isin(hs))
    for i, h in enumerate(hs):
        data = data.withColumn(f"h{i}", (F.col("horizon") == h).cast("double"))
    early = data.filter(F.col("date") < split)
    stats = early.agg(*(F.median(x).alias(f"m_{x}") for x in spectral + control), *(F.avg(x).alias(f"a_{x}") for x in spectral + control), *(F.stddev_pop(x).alias(f"s_{x}") for x in spectral + control)).first()
    for x in spectral + control:
        data = data.withColumn(x, (F.coalesce(F.col(x), F.lit(stats[f"m_{x}"])) - stats[f"a_{x}"]) / (stats[f"s_{x}"] or 1.0))
    data = stored(with_date_weight(data, ("return_mode",)), "design-rows")
    for mode in sorted(r[0] for r in data.select("return_mode").distinct().collect()):
        own = data.filter(F.col("return_mode") == mode)
        train, test = own.filter(F.col("date") < split), own.filter(F.col("date") >= split)
        total = train.agg(F.sum("weight")).first()[0]
        for design, columns in {"horizon_only": [], "spectral": spectral, "controls": control, "both": spectral + control}.items():
            make = VectorAssembler(inputCols=[*columns, *(f"h{i}" for i in range(len(hs)))], outputCol="features")
            fit = LogisticRegression(labelCol="phase_label", weightCol="weight", regParam=1.0 / (c * total), standardization=False, maxIter=100).fit(make.transform(train))
            got = fit.transform(make.transform(test)).select("weight", "phase_label", _second("probability").alias("score"))
            line = score_metrics(got.withColumns({"return_mode": F.lit(mode), "design": F.lit(design)}), ("return_mode", "design"), "score", "phase_label", "weight")
            out = line if out is None else out.unionByName(line)
    return out


def _second(column: str):
    from pyspark.ml.functions import vector_to_array

    return F.get(vector_to_array(column), F.lit(1))
