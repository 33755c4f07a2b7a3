"""Loading a product catalogue from CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from shelfscope.operators.numbering import number_rows
from shelfscope.schemas import CATALOG_COLUMNS
from shelfscope.session import stored
from shelfscope.sources import csv_records, versions

# fixed values: dialect of the catalogue files
CSV_OPTIONS = {
    "header": "true", "sep": ",", "quote": '"', "escape": '"',
    "mode": "PERMISSIVE", "maxCharsPerColumn": "-1",
}
# a quoted empty field is the empty text, an unquoted one is missing: the reader marks
# the former with this private-use character so that both survive
_EMPTY = "\uE000"
_LINE = "_line"
BROKEN = "broken"


def _text(column: str) -> Column:
    value = F.col(f"`{column}`")
    return F.when(value == _EMPTY, F.lit("")).otherwise(value)


def csv_scan(
    spark: SparkSession,
    path: str,
    aliases: dict[str, str] | None = None,
    multi_line: bool = False,
    with_broken: bool = False,
) -> DataFrame:
    """The catalogue columns of a CSV file or folder, all as text.

    Column names come from the header, ``aliases`` (file name -> catalogue name) renames
    those that differ. Short rows are padded with NULL and extra fields cut off. Types
    are never inferred. Without ``multi_line`` the data is read once, and ``with_broken`` adds
    a flag for lines whose quotes do not pair and whose number of fields is not the header's, as
    the halves of a row with a quoted line break. With ``multi_line`` such rows are whole: files are
    split all the same and read two or three times (``csv_records``), and only a record that its file does
    not finish is broken. Files whose header differs from the first one's fail the read.
    """
    reader = spark.read.options(**CSV_OPTIONS, emptyValue=_EMPTY)
    header = reader.csv(path).columns
    schema = ", ".join(f"`{c}` string" for c in header)
    if multi_line:
        options = {k: v for k, v in CSV_OPTIONS.items() if k != "header"} | {"emptyValue": _EMPTY}
        found = csv_records.records(spark, path, header)
        parsed = F.from_csv("record", schema, options)
        raw = found.select(parsed.alias("_r"), "unfinished").select("_r.*", "unfinished")
    else:
        raw = reader.options(enforceSchema="false", columnNameOfCorruptRecord=_LINE).schema(
            f"{schema}, {_LINE} string"
        ).csv(path)
    names = {(aliases or {}).get(c, c): c for c in header}
    missing = [c for c, _ in CATALOG_COLUMNS if c not in names]
    if "title" in missing or "rating" in missing or "category" in missing:
        raise ValueError(f"catalogue lacks columns {missing}")
    if multi_line:
        flag = F.col("unfinished")
    else:
        # a line with another number of fields than the header comes with its text
        quotes = F.length(_LINE) - F.length(F.replace(F.col(_LINE), F.lit('"'), F.lit("")))
        flag = F.coalesce(quotes % 2 == 1, F.lit(False))
    broken = [flag.alias(BROKEN)] if with_broken else []
    return raw.select(
        *[
            _text(names[c]).alias(c) if c in names else F.lit(None).cast("string").alias(c)
            for c, _ in CATALOG_COLUMNS
        ],
        *broken,
    )


def _convert(name: str, target: str) -> Column:
    """A text column in its catalogue type; NULL when the text does not convert.

    Whole numbers accept decimals and round them, as the fractional types do.
    """
    text = F.trim(F.col(name))
    if target == "string":
        return F.col(name)
    if target == "int":
        return F.round(text.try_cast("decimal(38,10)"), 0).try_cast("int")
    return text.try_cast(target)


def typed(scanned: DataFrame, strict: bool = False) -> DataFrame:
    """Typed columns plus ``rejected``: a non-empty text that did not convert, or a line
    flagged as broken.

    ``strict`` raises on the first such value instead.
    """
    bad = F.col(BROKEN) if BROKEN in scanned.columns else F.lit(False)
    if strict and BROKEN in scanned.columns:
        message = F.concat(F.lit("unpaired quote near: "), F.coalesce("title", F.lit("")))
        bad = F.when(bad, F.raise_error(message).cast("boolean")).otherwise(bad)
    columns = []
    for name, target in CATALOG_COLUMNS:
        value = _convert(name, target)
        if target != "string":
            failed = value.isNull() & (F.length(F.trim(F.col(name))) > 0)
            if strict:
                message = F.concat(F.lit(f"bad {name}: "), F.col(name))
                value = F.when(failed, F.raise_error(message).cast(target)).otherwise(value)
            bad = bad | F.coalesce(failed, F.lit(False))
        columns.append(value.alias(name))
    return scanned.select(*columns, bad.alias("rejected"))


def usable(rows: DataFrame) -> DataFrame:
    """Accepted rows with a positive rating and a category."""
    return rows.filter(
        ~F.col("rejected") & (F.col("rating") > 0) & F.col("category").isNotNull()
    ).drop("rejected")


def _counts() -> list[Column]:
    kept = ~F.col("rejected") & (F.col("rating") > 0) & F.col("category").isNotNull()
    return [
        F.count("*").alias("read"),
        F.count_if("rejected").alias("rejected"),
        F.count_if(kept).alias("kept"),
    ]


def load_counts(rows: DataFrame) -> DataFrame:
    """One row: rows read, rows rejected for a bad value and rows kept, in one pass."""
    return rows.agg(*_counts())


def load_catalog(
    spark: SparkSession,
    path: str,
    target: str | None = None,
    order_by: Sequence[str] = (),
    aliases: dict[str, str] | None = None,
    strict: bool = False,
    multi_line: bool = False,
    counts: Observation | None = None,
) -> DataFrame:
    """Scan, convert, filter and number a CSV catalogue; optionally replace ``target``.

    ``target`` is a table of ``versions`` that is replaced in one step and read back. Without
    ``order_by`` the ids follow the file splits and numbering needs no shuffle. ``counts``
    receives rows read, rejected and kept from the same pass.
    """
    rows = typed(csv_scan(spark, path, aliases, multi_line, with_broken=True), strict)
    if counts is not None:
        rows = rows.observe(counts, *_counts())
    rows = usable(rows)
    if order_by:
        # the text is parsed once, though a range sort reads its input twice
        rows = stored(rows, "catalog-rows", "zstd")
    loaded = number_rows(rows, order_by)
    if target is None:
        return loaded
    return versions.read(spark, target, versions.replace(loaded, target))


#: rows of a compressed file: such files are not split, each is the work of one task
PACKED = {"compression": "gzip", "maxRecordsPerFile": 250_000}


def write_csv(df: DataFrame, path: str, packed: bool = False) -> None:
    """Write a catalogue in the dialect ``csv_scan`` reads; ``packed``: compressed, in files of
    bounded size."""
    more = PACKED if packed else {}
    df.write.mode("overwrite").options(header="true", quote='"', escape='"', emptyValue='""', **more).csv(path)
