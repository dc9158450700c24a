"""Result files: one line ``idx #[S ms hb, …] key.`` per unit and repetition, one item per variant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.keys import escape_key, module_of_folder, module_of_path, normalize_key, parse_key
from runlens.operators.joins import HOT_LIST
from runlens.operators.ordered import ranges, scan_groups, with_index
from runlens.schemas import STATUS, is_success
from runlens.session import fresh_path, keep
from runlens.sources.files import list_files, write_named
from runlens.sources.lines import PLACE, read_lines

# Line pattern of the lenient reader, header lines of a result file.
LENIENT_LINE = r"^(\d+)\s+#\[(.*?)\]\s+(.+)"
STRICT_LINE = r"^\S* #\[([^\]]*)\] (.*)$"
STRICT_ITEM = r"^([" + "".join(STATUS) + r"]) ([0-9]+) ([0-9]+)$"
SUMMARY = "Summary:"
NO_TIME = "Total elapsed time: Not applicable"
ELAPSED = "Total elapsed time : {} ms"


def parse_lenient(lines: DataFrame, variants: Sequence[str], decode_keys: bool = False) -> DataFrame:
    """Result lines with ``outcome``, ``unit`` and ``items`` up to the first bad item.

    Lines that do not begin with a digit are no result lines. ``outcome`` is ok, no_match,
    wrong_length or misformatted_result.
    """
    value = F.col("value")
    key = F.rtrim(F.regexp_extract(value, LENIENT_LINE, 3), F.lit("."))
    items = F.transform(
        F.split(F.regexp_extract(value, LENIENT_LINE, 2), ", "),
        lambda item: F.struct(
            F.get(F.split(F.trim(item), r"\s+"), 0).alias("status"),
            F.get(F.split(F.trim(item), r"\s+"), 1).try_cast("bigint").alias("ms"),
        ),
    )
    rows = lines.filter(value.rlike("^[0-9]")).select(
        *[c for c in lines.columns],
        (normalize_key(key) if decode_keys else key).alias("unit"),
        items.alias("_items"),
        value.rlike(LENIENT_LINE).alias("_match"),
    )
    bad = F.array_position(F.transform("_items", lambda i: i["ms"].isNull()), True)
    outcome = (
        F.when(~F.col("_match"), "no_match")
        .when(F.size("_items") != len(variants), "wrong_length")
        .when(bad > 0, "misformatted_result")
        .otherwise("ok")
    )
    usable = (
        F.when(outcome == "ok", F.col("_items"))
        .when(outcome == "misformatted_result", F.slice("_items", 1, (bad - 1).cast("int")))
    )
    return rows.select(*lines.columns, "unit", outcome.alias("outcome"), usable.alias("items"))


def runs_of(parsed: DataFrame, variants: Sequence[str], drop_line: bool = False) -> DataFrame:
    """Runs ``variant, unit, ok, value`` (ms) of parsed lines.

    Items before the first bad one count, unless ``drop_line``.
    """
    rows = parsed.filter(F.col("outcome") == "ok") if drop_line else parsed
    names = F.array(*[F.lit(v) for v in variants])
    return rows.select("unit", F.posexplode("items").alias("_pos", "_item")).select(
        F.element_at(names, F.col("_pos") + 1).alias("variant"),
        "unit",
        is_success(F.col("_item.status")).alias("ok"),
        F.col("_item.ms").alias("value"),
    )


def parse_errors(parsed: DataFrame) -> DataFrame:
    """Number of lines per outcome other than ok."""
    return parsed.filter(F.col("outcome") != "ok").groupBy("outcome").agg(F.count("*").alias("lines"))


def read_runs(spark: SparkSession, path, variants: Sequence[str], glob: str = "*.result", **options) -> DataFrame:
    """Runs of all result files below ``path``, lenient."""
    parsed = parse_lenient(read_lines(spark, path, glob), variants, options.pop("decode_keys", False))
    return runs_of(parsed, variants, **options)


def _in_body() -> Column:
    """Lines after the header, once ``_start`` is joined."""
    return (F.col("block") > 0) | (F.col("seq") - F.col("_start") >= 4)


def _fail(message: Column) -> Column:
    return F.raise_error(message).cast("boolean")


def _starts(lines: DataFrame) -> DataFrame:
    """``path, _start``: the first line's number per file; a file without the four header lines is an error.

    Rows of few files are broadcast, so that the lines of a long file stay where they are.
    """
    first = lines.filter(F.col("block") == 0)
    start = keep(first.groupBy("path").agg(F.min("seq").alias("_start")), "starts")
    few = start.count() <= HOT_LIST
    start = F.broadcast(start) if few else start
    place = F.col("seq") - F.col("_start")
    header = F.max((place == 2) & (F.col("value") == SUMMARY)) & F.max((place == 3) & (F.col("value") == ""))
    found = first.join(start, "path").groupBy("path", "_start").agg(header.alias("_header"))
    wrong = F.concat(F.lit("format of result file changed: "), F.col("path"))
    starts = found.filter(F.when(F.col("_header"), F.lit(True)).otherwise(_fail(wrong))).select("path", "_start")
    return F.broadcast(starts) if few else starts


def read_strict(spark: SparkSession, path, glob: str = "*.result") -> DataFrame:
    """Result lines with every line and item checked: ``path, block, seq, key, results``.

    ``results`` is an array of (status, ms, hb). A file without the header, a line after it that is neither empty nor a
    result, or an item that is not ``<status> <ms> <hb>`` with a known status, is an error, whichever columns are used.
    """
    # Written, so that line numbers are the same for the header and the rest.
    lines = keep(read_lines(spark, path, glob), "lines")
    where = F.concat(F.lit("in file "), F.col("path"), F.lit(": "))
    bad = F.get(F.filter(_items(F.col("value")), lambda item: ~item.rlike(STRICT_ITEM)), 0)
    # One condition, so that no part of it is asked of header lines.
    wanted = (
        F.when(~_in_body() | (F.col("value") == ""), F.lit(False))
        .when(~F.col("value").rlike(STRICT_LINE), _fail(F.concat(where, F.col("value"), F.lit(" is no result line"))))
        .when(bad.isNotNull(), _fail(F.concat(where, bad, F.lit(" is not <status> <ms> <hb>"))))
        .otherwise(F.lit(True))
    )
    body = lines.join(_starts(lines), "path").filter(wanted)
    key = parse_key(F.regexp_extract("value", STRICT_LINE, 2))
    return body.select(*PLACE, key.alias("key"), strict_results(F.col("value")).alias("results"))


def strict_violations(spark: SparkSession, path, glob: str = "*.result") -> DataFrame:
    """``path, value`` of the lines after a header that ``read_strict`` would refuse."""
    lines = keep(read_lines(spark, path, glob), "lines")
    body = lines.join(_starts(lines), "path").filter(_in_body())
    bad = ~F.col("value").rlike(STRICT_LINE) | F.exists(_items(F.col("value")), lambda item: ~item.rlike(STRICT_ITEM))
    return body.filter((F.col("value") != "") & bad).select("path", "value")


def _items(line: Column) -> Column:
    return F.split(F.regexp_extract(line, STRICT_LINE, 1), ", ")


def strict_results(line: Column) -> Column:
    """(status, ms, hb) of each item of a result line."""

    def one(item: Column) -> Column:
        fields = F.split(item, " ")
        return F.struct(
            fields[0].alias("status"), fields[1].cast("bigint").alias("ms"), fields[2].cast("bigint").alias("hb")
        )

    return F.transform(_items(line), one)


def read_tree(spark: SparkSession, root: str, suffix: str = ".result") -> DataFrame:
    """All result files below ``root``, strict, with the module from the path: ``module, key, results``."""
    rows = read_strict(spark, root, f"*{suffix}")
    return rows.select(module_of_path(F.col("path"), root, suffix).alias("module"), "key", "results", *PLACE)


def read_tree_tolerant(
    spark: SparkSession, root: str, planned: DataFrame, suffix: str = ".result"
) -> tuple[DataFrame, DataFrame]:
    """Results below ``root``, and the planned modules without any as ``module, state``; those are no error."""
    return read_tree(spark, root, suffix), not_returning(spark, root, planned, suffix)


def not_returning(spark: SparkSession, root: str, planned: DataFrame, suffix: str = ".result") -> DataFrame:
    """``module, state`` of planned modules that wrote nothing: ``empty`` file, or ``no_file`` at all.

    A file with a header and no result line has returned.
    """
    files = list_files(spark, root, suffix).select(module_of_path(F.col("path"), root, suffix).alias("module"), "length")
    sizes = files.groupBy("module").agg(F.max("length").alias("_length"))
    state = F.when(F.col("_length").isNull(), "no_file").when(F.col("_length") == 0, "empty")
    found = planned.select("module").distinct().join(sizes, "module", "left")
    return found.select("module", state.alias("state")).filter(F.col("state").isNotNull())


def write_not_returning(modules: DataFrame, path: str) -> None:
    """The list of modules that wrote nothing: one name per line, in order."""
    modules.filter(F.col("state") == "empty").orderBy("module").select(F.col("module").alias("value")).write.text(path)


def result_text(key: Column, results: Column, index: Column) -> Column:
    """One result line."""
    items = F.transform(results, lambda r: F.concat_ws(" ", r["status"], r["ms"].cast("string"), r["hb"].cast("string")))
    return F.format_string("%d #[%s] %s", index, F.array_join(items, ", "), escape_key(key))


def _header_rows(first: str) -> Column:
    lines = [(-4, first), (-3, ""), (-2, SUMMARY), (-1, "")]
    return F.array(*[F.struct(F.lit(i).cast("bigint").alias("idx"), F.lit(v).alias("value")) for i, v in lines])


def _header(spark: SparkSession, first: str) -> DataFrame:
    return spark.range(1).select(F.explode(_header_rows(first)).alias("_h")).select("_h.*")


def gather_lines(results: DataFrame, order: Sequence[str], first: str = NO_TIME) -> DataFrame:
    """All result lines under one header, numbered over all files: ``idx, value``."""
    numbered = with_index(results, order)
    body = numbered.select("idx", result_text(F.col("key"), F.col("results"), F.col("idx")).alias("value"))
    return _header(results.sparkSession, first).unionByName(body)


def write_gathered(lines: DataFrame, path: str, first: str = NO_TIME) -> None:
    """Write numbered lines as text files that follow the order of ``idx``; each file begins with the header.

    However many files there are, ``read_strict`` reads all of them.
    """
    body = keep(lines.filter(F.col("idx") >= 0).select("idx", "value"), "gathered")
    # Each task writes one file; its first row, the only one with no row before it in the partition, takes the header along.
    placed = ranges(body, ["idx"], body.count()).sortWithinPartitions("idx")
    begins = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    header = F.transform(_header_rows(first), lambda row: row["value"])
    own = F.array("value")
    placed.select(F.explode(F.when(begins, F.concat(header, own)).otherwise(own)).alias("value")).write.text(path)


def _module_lines(results: DataFrame, order: Sequence[str], elapsed_ms: int, planned: DataFrame | None = None) -> DataFrame:
    """``module, seq, value``: the header of each module (of ``results`` and ``planned``) and its numbered result lines."""
    ones = results.withColumn("_one", F.lit(1).cast("long"))
    numbered = scan_groups(ones, ["module"], order, running={"_n": ("sum", "_one")})
    idx = F.col("_n") - 1
    body = numbered.select("module", idx.alias("seq"), result_text(F.col("key"), F.col("results"), idx).alias("value"))
    modules = results.select("module")
    if planned is not None:
        modules = modules.unionByName(planned.select("module"))
    heads = modules.distinct().select("module", F.explode(_header_rows(ELAPSED.format(elapsed_ms))).alias("_h"))
    return body.unionByName(heads.select("module", F.col("_h.idx").alias("seq"), "_h.value"))


def write_modules(results: DataFrame, order: Sequence[str], path: str, elapsed_ms: int = 0) -> None:
    """Write one result file per module, numbered inside the module, below a folder ``module=…``; ``read_written`` reads them."""
    file = F.concat(F.lit("module="), F.url_encode("module"), F.lit("/results.txt"))
    write_named(_module_lines(results, order, elapsed_ms).select(file.alias("file"), "seq", "value"), path)


def written_modules(results: DataFrame, order: Sequence[str]) -> str:
    """``write_modules`` into a new folder of the working area; returns its path."""
    path = fresh_path(results.sparkSession, "results")
    write_modules(results, order, path)
    return path


def write_tree(
    results: DataFrame,
    order: Sequence[str],
    planned: DataFrame,
    root: str,
    suffix: str = ".result",
    elapsed_ms: int = 0,
    empty: DataFrame | None = None,
) -> None:
    """One file ``<root>/<module path><suffix>`` per module of ``planned``; those without results get the header alone.

    The modules of ``empty`` get files without content, as runs leave that died. Tasks write the files under their names.
    """
    lines = _module_lines(results, order, elapsed_ms, planned)
    if empty is not None:
        lines = lines.unionByName(empty.select("module", F.lit(0).cast("long").alias("seq"), F.lit(None).cast("string").alias("value")))
    file = F.concat(F.replace(F.col("module"), F.lit("."), F.lit("/")), F.lit(suffix))
    write_named(lines.select(file.alias("file"), "seq", "value"), root)


def gather_tree(spark: SparkSession, root: str, planned: DataFrame, path: str, suffix: str = ".result") -> None:
    """The end of a run in one call: all results below ``root`` under ``<path>/gathered``, in the order of modules and
    lines, and the planned modules whose file is empty under ``<path>/not_returning``."""
    rows = read_tree(spark, root, suffix)
    write_gathered(gather_lines(rows, ["module", "block", "seq"]), f"{path}/gathered")
    write_not_returning(not_returning(spark, root, planned, suffix), f"{path}/not_returning")


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """Results of a folder written by ``write_modules``, strict: ``module, key, results``."""
    rows = read_strict(spark, path, "*.txt")
    return rows.select(module_of_folder(F.col("path")).alias("module"), "key", "results", *PLACE)
