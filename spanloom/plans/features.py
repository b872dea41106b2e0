"""Feature columns of variants, and the models that score them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, predicates, sequence
from ..operators import sets

SIDES = ("1", "2")


def first_or(columns: Sequence[str], k: int) -> Column:
    """Value k of a tag by breakpoint, or that of breakpoint 1 where the second is missing."""
    return F.coalesce(F.col(columns[k]), F.col(columns[0]))


def geometry(max_is: int) -> dict[str, Column]:
    n = F.abs(predicates.svlen())
    return {"SVLEN": n, "LOG_SVLEN": F.log1p(n), "SVLEN_OVER_IS": n / F.lit(float(max_is)), "INSLEN": F.length(F.coalesce("ins_seq", F.lit(""))), "IMPRECISE": F.col("imprecise").cast("int")}


def composition(seq: Column, name: str) -> dict[str, Column]:
    """Shares of the four bases of a sequence."""
    return {f"{name}_{b}": F.try_divide(sequence.base_count(seq, b).cast("double"), F.length(seq)) for b in "ACGT"}


def read_ratios(alt: str, ref: str, depth: str) -> dict[str, Column]:
    """Support against the other allele and against depth, and its balance of strands."""
    out = {}
    for k in SIDES:
        a, r = F.col(f"{alt}{k}"), F.col(f"{ref}{k}")
        out |= {f"{alt}{k}_SHARE": numeric.ratio(a, a + r), f"{alt}{k}_DEPTH": numeric.ratio(a, F.col(depth)), f"{ref}{k}_DEPTH": numeric.ratio(r, F.col(depth))}
        out[f"{alt}{k}_STRAND"] = numeric.ratio(F.least(f"{alt}{k}_FWD", f"{alt}{k}_REV"), F.greatest(f"{alt}{k}_FWD", f"{alt}{k}_REV"))
    return out


def depth_ratios(inside: str, left: str, right: str, typical: str) -> dict[str, Column]:
    t = F.col(typical)
    flank = (F.col(left) + F.col(right)) / 2
    return {"DEPTH_IN": numeric.piecewise(F.col(inside), t * 0.5, t * 1.5), "DEPTH_FLANK": numeric.piecewise(flank, t * 0.5, t * 1.5), "DEPTH_CHANGE": numeric.ratio(F.col(inside), flank)}


def quality_shift(a: str, b: str) -> dict[str, Column]:
    """Welch's z of two groups given by mean, deviation and number columns."""
    z = numeric.welch_z(*[F.col(f"{x}_{s}").cast("double") for x in (a, b) for s in ("avg_q", "sd_q", "n")])
    return {f"Z_{a}_{b}": z}


def with_features(variants: DataFrame, features: dict[str, Column]) -> DataFrame:
    """variants with all features in one projection, as doubles; missing stays null."""
    return variants.select("*", *[c.cast("double").alias(k) for k, c in features.items()])


def donor_metrics(variants: DataFrame, links: DataFrame, metric: str) -> DataFrame:
    """id, donor, metric of the strongest donor: links (id, donors "a,b,c") exploded, joined, the largest metric kept."""
    each = links.select("id", F.explode(F.split("donors", ",")).alias("donor")).where("donor <> ''")
    j = each.join(variants.select(F.col("id").alias("donor"), F.col(metric).alias("_m")), "donor")
    return j.groupBy("id").agg(F.max_by("donor", F.struct("_m", "donor")).alias("donor"), F.max("_m").alias(metric))


def train(df: DataFrame, columns: Sequence[str], label: str, trees: int = 50, depth: int = 5, rate: float = 0.1, seed: int = 7) -> tuple[PipelineModel, list[str]]:
    """Boosted trees on the columns that have values that differ; missing values take the median."""
    used = sets.informative(df, columns)
    if not used or df.select(label).where(F.col(label).isNotNull()).distinct().count() < 2:
        raise ValueError("no feature or label that differs")
    rows = df.where(F.col(label).isNotNull()).withColumn("_label", F.col(label).cast("double"))
    filled = [f"_f_{c}" for c in used]
    steps = [Imputer(strategy="median", inputCols=used, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_v"), GBTClassifier(labelCol="_label", featuresCol="_v", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)]
    return Pipeline(stages=steps).fit(rows.select(*used, "_label")), used


def probability(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """df with the probability of the positive class."""
    extra = [c for c in ("rawPrediction", "prediction", "_v")]
    out = model.transform(df)
    return out.withColumn(name, vector_to_array("probability")[1]).drop("probability", *extra, *[c for c in out.columns if c.startswith("_f_")])


def importances(model: PipelineModel, used: Sequence[str], k: int = 20) -> list[tuple[str, float]]:
    return sorted(zip(used, model.stages[-1].featureImportances.toArray().tolist()), key=lambda x: -x[1])[:k]


def train_by_model(df: DataFrame, columns: Sequence[str], models: Sequence[str], **options) -> dict[str, dict[str, PipelineModel]]:
    """For each model name: whether a variant exists (all rows), and whether it is homozygous (those that exist)."""
    out = {}
    for m in models:
        rows = df.where(F.col("model") == m)
        steps = {}
        for target, sub in (("exists", rows), ("hom", rows.where("exists = 1"))):
            try:
                steps[target] = train(sub, columns, target, **options)[0]
            except ValueError:
                continue
        if steps:
            out[m] = steps
    return out


def apply_models(df: DataFrame, models: dict[str, dict[str, PipelineModel]]) -> DataFrame:
    """id, epr, hopr: probabilities by each row's model; rows without a model get none."""
    out = None
    for m, steps in models.items():
        rows = df.where(F.col("model") == m)
        rows = probability(steps["exists"], rows, "epr") if "exists" in steps else rows.withColumn("epr", F.lit(None).cast("double"))
        rows = probability(steps["hom"], rows, "hopr") if "hom" in steps else rows.withColumn("hopr", F.lit(None).cast("double"))
        rows = rows.select("id", "epr", "hopr")
        out = rows if out is None else out.unionByName(rows)
    rest = df.where(~F.col("model").isin(list(models)) | F.col("model").isNull()).select("id", F.lit(None).cast("double").alias("epr"), F.lit(None).cast("double").alias("hopr"))
    return rest if out is None else out.unionByName(rest)
