"""Text reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions.numeric import number_text


def outlier_text() -> Column:
    """Record of six lines and an empty one for a row with ``file, unit, syntax`` and the times in ms; NULL is empty."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    def number(name: str, unit: str) -> Column:
        return F.coalesce(number_text(F.col(name), 2, unit), F.lit(""))

    # The labels of a record.
    return F.concat(
        F.lit("file:     "), text("file"),
        F.lit("\nname:     "), text("unit"),
        F.lit("\nsyntax:   "), text("syntax"),
        F.lit("\nold_time: "), number("old_ms", " ms"),
        F.lit("\nnew_time: "), number("new_ms", " ms"),
        F.lit("\nslowdown: "), number("slowdown", "x"),
        F.lit("\n"),
    )


def write_outliers(rows: DataFrame, path: str) -> None:
    """Write records worst first; part files follow that order."""
    ordered = rows.orderBy(F.col("slowdown").desc_nulls_last(), "unit")
    ordered.select(outlier_text().alias("value")).write.text(path)


def figure_lines(series: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Lines of a numbers file: per figure its title, then a label and a series per curve.

    ``series`` has ``figure, label, line, text``; ``labels`` gives each figure's title. Rows carry
    ``figure, label, line, part`` to order by.
    """
    title = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    heads = series.select("figure").distinct().select(
        "figure", F.lit("").alias("label"), F.lit(0).cast("bigint").alias("line"), F.lit(0).alias("part"),
        title[F.col("figure")].alias("value"),
    )
    names = series.select("figure", "label").distinct().select(
        "figure", "label", F.lit(0).cast("bigint").alias("line"), F.lit(1).alias("part"), F.col("label").alias("value")
    )
    body = series.select("figure", "label", "line", F.lit(2).alias("part"), F.col("text").alias("value"))
    return heads.unionByName(names).unionByName(body)


def write_figures(lines: DataFrame, path: str) -> None:
    lines.orderBy("figure", "label", "part", "line").select("value").write.text(path)


def tidy(df: DataFrame, section: str, keys: Sequence[str]) -> DataFrame:
    """Report rows ``section, key, metric, value`` of a wide result; a column that is neither key nor number is an error."""
    metrics = [c for c in df.columns if c not in keys]
    odd = [f.name for f in df.schema if f.name in metrics and not isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    if odd:
        raise ValueError(f"no numbers: {', '.join(odd)}")
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("all")
    return df.select(F.lit(section).alias("section"), name.alias("key"), F.explode(F.array(*cells)).alias("_m")).select(
        "section", "key", "_m.*"
    )


def report_text(report: DataFrame) -> DataFrame:
    """One line per report row."""
    line = F.concat_ws(": ", "section", "key", "metric", number_text(F.col("value"), 2))
    return report.select("section", "key", "metric", line.alias("value"))
