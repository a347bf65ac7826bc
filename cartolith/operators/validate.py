"""Gates over reports: every failure is named, the report is written first, then the query fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.operators.features import checked


def failures(rules: list[tuple[str, Column]]) -> Column:
    """The names of the rules that are broken, in the rules' order. A rule that is null counts as broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(good, F.lit(False)), F.lit(name)) for name, good in rules)))


def alignment_gate(report: DataFrame, least_iou: float, least_f: float) -> DataFrame:
    """report (iou, boundary_f, ...) with failures."""
    return report.withColumn("failures", failures([("contour IoU is below the minimum", F.col("iou") >= least_iou), ("boundary F score is below the minimum", F.col("boundary_f") >= least_f)]))


PLACEMENT = ("inside_ratio", "contour_iou", "overseas_area", "wrong_country_area", "overlap_area", "labels_outside", "invalid_count")


def placement_gate(report: DataFrame, least_inside: float, least_iou: float, most_overseas: float, most_wrong: float) -> DataFrame:
    """report (PLACEMENT) with failures, in the order of its columns."""
    c = {n: F.col(n) for n in PLACEMENT}
    return report.withColumn(
        "failures",
        failures(
            [
                ("regions are not mostly inside the territory", c["inside_ratio"] >= least_inside),
                ("contour IoU is below the minimum", c["contour_iou"] >= least_iou),
                ("regions meet an overseas part", c["overseas_area"] <= most_overseas),
                ("regions meet another country", c["wrong_country_area"] <= most_wrong),
                ("regions overlap", c["overlap_area"] <= 1e-8),
                ("labels are outside their regions", c["labels_outside"] == 0),
                ("shapes are invalid", c["invalid_count"] == 0),
            ]
        ),
    )


LINEWORK = ("inside_ratio", "contour_iou", "overseas_area", "wrong_country_area", "labels_outside", "area_ratio", "missing_pairs")


def linework_gate(report: DataFrame, least_inside: float, least_iou: float, most_overseas: float, most_wrong: float) -> DataFrame:
    """report (LINEWORK) with failures, in the order of its columns."""
    c = {n: F.col(n) for n in LINEWORK}
    return report.withColumn(
        "failures",
        failures(
            [
                ("regions are not mostly inside the territory", c["inside_ratio"] >= least_inside),
                ("contour IoU is below the minimum", c["contour_iou"] >= least_iou),
                ("regions meet an overseas part", c["overseas_area"] <= most_overseas),
                ("regions meet another country", c["wrong_country_area"] <= most_wrong),
                ("labels are outside their regions", c["labels_outside"] == 0),
                ("outlines and cells differ in area", F.abs(c["area_ratio"] - 1) <= 1e-8),
                ("required borders are missing", c["missing_pairs"] == 0),
            ]
        ),
    )


def enforce(report: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the report where a path is given, then passes only rows without failures."""
    if path is not None:
        report.write.mode("overwrite").json(path)
    return checked(report, F.size("failures") == 0, F.array_join("failures", "; "))


def disjoint(cells: DataFrame, first: str, second: str, owner: str = "owner") -> DataFrame:
    """One row: cells that two owners share, and whether that is none."""
    mine = cells.where(F.col(owner).isin(first, second)).select(owner, "x", "y").distinct()
    shared = mine.groupBy("x", "y").count().where("count > 1")
    return shared.agg(F.count(F.lit(1)).alias("shared")).withColumn("disjoint", F.col("shared") == 0)


def fill_counters(cells: DataFrame) -> DataFrame:
    """One row of counts over filled cells: land, country, unclaimed, before, after (labels, 0 for none)."""
    land, free = F.col("land"), F.col("unclaimed")
    assigned = land & ~free & (F.col("after") > 0)
    return cells.agg(
        F.count_if(land & (F.col("before") > 0) & (F.col("before") != F.col("after"))).alias("changed_inside_land"),
        F.count_if(~land & (F.col("after") > 0)).alias("filled_outside_land"),
        F.count_if(assigned).alias("assigned_land"),
        F.count_if(land & free).alias("unclaimed_land"),
        F.count_if(land & ~free & (F.col("after") == 0)).alias("unresolved_land"),
        F.count_if(land).alias("land_cells"),
    ).withColumn("balanced", F.col("assigned_land") + F.col("unclaimed_land") + F.col("unresolved_land") == F.col("land_cells"))


def one_label_each(features: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, n) of features with no label or several, and of labels without a feature."""
    counts = labels.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return features.select("id").distinct().join(counts, "id", "full").where(~F.col("n").eqNullSafe(F.lit(1)) | F.col("id").isNull()).select("id", F.coalesce("n", F.lit(0)).alias("n")).union(labels.join(features, "id", "left_anti").groupBy("id").agg(F.count(F.lit(1)).alias("n"))).distinct()


def expected_count(labels: DataFrame, expected: int) -> DataFrame:
    """One row with the number of labels; fails if it isn't the expected one."""
    return checked(labels.agg(F.count(F.lit(1)).alias("n")), F.col("n") == expected, "unexpected number of labels")


def clearance_guard(points: DataFrame, clearance: str = "clearance") -> DataFrame:
    return checked(points, F.col(clearance) > 0, "a label is on its boundary")
