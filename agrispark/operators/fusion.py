"""The whole run of two detectors' fusion on fields: fuse, label, choose a threshold, merge, and evaluate all layers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from agrispark.operators import spatial as J
from agrispark.operators.coverage import within_union
from agrispark.operators.polygons import merge_union
from agrispark.session import stored


@dataclass
class FusionRun:
    """What a run on one field gives.

    layer: the merged layer, ``group_id, n, minx, miny, maxx, maxy, conf,
    conf_first, conf_second, source, gt_label, predicted, result``; a merged
    box has the attributes of its most confident part. threshold: that of the
    greatest TPR - FPR, None if the fused rows hold one kind only. counts:
    ``layer, tp, fp, fn`` of first, second and fused.
    """

    layer: DataFrame
    threshold: float | None
    counts: DataFrame


def fusion_run(first: DataFrame, second: DataFrame, truths: DataFrame, buffer: float = 2.0, least: float = 0.3, method: str = "minmax", iou: float = 0.5, size: float = 1.0) -> FusionRun:
    """One field: ``first`` (pred_id, conf) and ``second`` (svm_id, margin) against ``truths`` (gt_id), all with bounds.

    A fused row is a truth if it lies in the union of the truths grown by
    ``buffer``. Building it runs the fusion, which is written to the shared
    folder with an id for each row, and finds the threshold.
    """
    fused = J.fuse_layers(first, second, buffer, least, method, size)
    fused = stored(fused.withColumn("pred_id", F.monotonically_increasing_id()))
    truth = within_union(fused, truths, buffer, "pred_id", size).withColumnRenamed("inside", "gt_label")
    labelled = stored(fused.join(truth, "pred_id"))
    kinds = labelled.agg(F.min("gt_label"), F.max("gt_label")).first()
    threshold = None
    if kinds[0] != kinds[1]:
        threshold = J.youden(J.roc_points(labelled, "confidence", "gt_label")).first()["threshold"]
    cut = F.lit(threshold).cast("double")
    tagged = labelled.withColumn("predicted", F.coalesce((F.col("confidence") >= cut).cast("int"), F.lit(0)))
    real, on = F.col("gt_label") == 1, F.col("predicted") == 1
    tagged = tagged.withColumn("result", F.when(on & real, "TP").when(on, "FP").when(real, "FN").otherwise("TN"))
    merged = merge_union(labelled.select("pred_id", F.lit(0).alias("class_id"), F.col("confidence").alias("conf"), *J.BOX), "pred_id", size).drop("class_id", "source")
    facts = tagged.select(F.col("pred_id").alias("best_id"), "conf_first", "conf_second", "source", "gt_label", "predicted", "result")
    layer = stored(merged.join(facts, "best_id").drop("best_id"))
    layers = {"first": first.select("pred_id", *J.BOX), "second": second.select(F.col("svm_id").alias("pred_id"), *J.BOX), "fused": layer.select(F.col("group_id").alias("pred_id"), *J.BOX)}
    counts = [J.confusion(rows, truths, iou, size).select(F.lit(name).alias("layer"), "tp", "fp", "fn") for name, rows in layers.items()]
    return FusionRun(layer, threshold, reduce(DataFrame.unionByName, counts))


def fusion_report(runs: dict[str, FusionRun]) -> DataFrame:
    """``field, layer, tp, fp, fn`` and the scores of each field and layer, and of each layer over all fields ('all')."""
    rows = reduce(DataFrame.unionByName, [run.counts.withColumn("field", F.lit(name)) for name, run in runs.items()])
    total = rows.groupBy("layer").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))).withColumn("field", F.lit("all"))
    return J.scores(rows.unionByName(total)).select("field", "layer", "tp", "fp", "fn", "precision", "recall", "f1", "accuracy")
