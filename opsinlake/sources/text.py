"""Two-column text spectra in, curves and comparison tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsinlake.functions.bind import let

NO_DATA = 1.0e30
MICROMETRE_BELOW = 50.0
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"  # no type suffixes, which a cast would take


def parse_points(text: Column) -> Column:
    """Points of a text spectrum in file order, as ``array<struct<line,wl,v>>``.

    Fields are parted by commas and blanks, also ahead of the first. Lines whose first two fields are not plain decimal
    numbers (so comments and blank lines, too) are skipped, as are values of 1e30 and more. When the largest wavelength lies in (0, 50) the text is in
    micrometres. A text is one value of one row, so parsing is a projection.
    """
    lines = F.transform(
        F.split(text, r"\r?\n"), lambda t, i: F.struct(i.cast("long").alias("line"), F.trim(t).alias("t"))
    )

    def number(fields, i):
        field = F.get(fields, F.lit(i))
        return F.when(field.rlike(NUMBER), field.try_cast("double"))

    def parse(x):
        return let(F.split(F.regexp_replace(x["t"], r"^[,\s]+", ""), r"[,\s]+"), lambda f: F.struct(
            x["line"].alias("line"), number(f, 0).alias("wl"), number(f, 1).alias("v")))

    good = F.filter(
        F.transform(lines, parse), lambda p: (F.abs(p["wl"]) < float("inf")) & (F.abs(p["v"]) < NO_DATA)
    )

    def scaled(points):
        def by_unit(top):
            unit = F.when((top > 0) & (top < MICROMETRE_BELOW), F.lit(1000.0)).otherwise(F.lit(1.0))
            return let(unit, lambda u: F.transform(points, lambda p: F.struct(
                p["line"].alias("line"), (p["wl"] * u).alias("wl"), p["v"].alias("v"))))

        return let(F.array_max(F.transform(points, lambda p: p["wl"])), by_unit)

    return let(good, scaled)


def parse_spectra(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """Whole files to ``file, line, wl, v`` rows."""
    return files.select(F.col(file).alias("file"), F.inline(parse_points(F.col(text))))


def read_spectra(spark: SparkSession, path: str) -> DataFrame:
    """Text spectra under a path: one row per file, points in file order; files without a point are left out."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    parsed = files.select("file", parse_points(F.col("value")).alias("_p")).where(F.size("_p") > 0)
    return parsed.select(
        "file", F.transform("_p", lambda p: F.struct(p["wl"].alias("wl"), p["v"].alias("v"))).alias("points")
    )


def curve_rows(curves: DataFrame, points: str = "points") -> DataFrame:
    """Points as rows in their stored order."""
    kept = [c for c in curves.columns if c != points]
    return curves.select(*kept, F.posexplode(points).alias("pos", "_p")).select(
        *kept, "pos", F.col("_p.wl").alias("wavelength_nm"), F.col("_p.v").alias("value")
    )


def write_curve(curve: DataFrame, path: str, points: str = "points") -> None:
    """One curve as ``wavelength_nm,value`` text."""
    rows = curve_rows(curve.select(points), points).orderBy("pos").select("wavelength_nm", "value")
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_table(table: DataFrame, path: str) -> None:
    """Comma-separated table with a header per file; quotes are doubled and nulls are empty fields."""
    table.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option(
        "nullValue", "").option("emptyValue", "").csv(path)
