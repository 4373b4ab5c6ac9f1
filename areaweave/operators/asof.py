"""Choosing a release by date, and joining each release on the codes of its own boundary edition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaweave.functions.temporal import OutOfRange, Release, pick_release

#: Windows up to which a choice is one expression; more are joined as a table.
LITERAL_RELEASES = 64


def releases_table(spark, releases: list[Release]) -> DataFrame:
    return spark.createDataFrame([(r.id, r.start, r.end, r.midpoint) for r in releases], "release string, start date, end date, midpoint date")


def asof_release(rows: DataFrame, day: str, releases: list[Release], rule: str = "closest_at_or_before", out_of_range: str = "fail", out: str = "release") -> DataFrame:
    """Add the release of each row's date. Releases are known beforehand, so no join is needed for a few dozen."""
    if len(releases) <= LITERAL_RELEASES:
        return rows.withColumn(out, pick_release(F.col(day), releases, rule, out_of_range))
    table = F.broadcast(releases_table(rows.sparkSession, releases))  # as many rows as the list has
    days = rows.select(F.col(day).alias("__day")).where("__day is not null").distinct()
    if rule == "closest":
        # the closest middle is the last one before the day or the first one after it: both are looked up in the sorted list
        ordered = list({r.midpoint: r for r in sorted(releases, key=lambda r: (r.midpoint, r.start), reverse=True)}.values())[::-1]
        middles = F.array(*[F.lit(r.midpoint) for r in ordered])
        after = F.size(F.filter(middles, lambda m: m <= F.col("__day")))
        known = F.array(*[F.struct(F.lit(r.id).alias("release"), F.lit(r.start).alias("start"), F.lit(r.midpoint).alias("midpoint")) for r in ordered])
        near = F.slice(known, F.greatest(after, F.lit(1)), F.lit(2))
        rank = F.transform(near, lambda r: F.struct(F.abs(F.datediff(F.col("__day"), r["midpoint"])).alias("far"), r["start"].alias("start"), r["release"].alias("release")))
        best = days.select("__day", F.array_min(rank)["release"].alias(out))
    else:
        best = days.join(table, F.col("start") <= F.col("__day")).groupBy("__day").agg(F.max_by("release", "start").alias(out))
    made = rows.join(best, F.col(day) == F.col("__day"), "left").drop("__day")
    if rule != "closest" and out_of_range == "nearest":
        first = min(releases, key=lambda r: r.start)
        made = made.withColumn(out, F.when(F.col(day).isNotNull(), F.coalesce(out, F.lit(first.id))))
    return made


def check_range(rows: DataFrame, day: str, release: str, dataset: str, pick=None) -> None:
    """Raise with a count and a sample if dates have no release; ``pick`` adds the release to rows that lack it."""
    rows = pick(rows) if pick else rows
    bad = rows.where(F.col(day).isNotNull() & F.col(release).isNull()).agg(F.count("*").alias("n"), F.min(day).alias("first")).first()
    if bad["n"]:
        raise OutOfRange(f"{bad['n']} {'dates' if pick else 'rows have dates'} before the first release of {dataset}, the earliest {bad['first']}")


def edition_code(release: str, editions: dict[str, int], codes: dict[int, str], reference: int = 3) -> Column:
    """The area code of the edition that a row's release was compiled for; an unknown release is of the reference edition."""
    edition = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in editions.items() for x in kv]), F.col(release)), F.lit(reference)) if editions else F.lit(reference)
    code = F.lit(None).cast("string")
    for n, c in codes.items():
        code = F.when(edition == n, F.col(c)).otherwise(code)
    return code


def cross_edition_join(rows: DataFrame, values: DataFrame, release: str, editions: dict[str, int], codes: dict[int, str], columns: dict[str, str], reference: int = 3, code_out: str | None = None, taken: DataFrame | None = None) -> DataFrame:
    """Join values of many releases at once, each on the area code of the edition it was compiled for.

    ``values``: ``release, sa2_code`` and the value columns. ``editions``: edition of each release. ``codes``: for each edition
    the column of ``rows`` with its code; ``code_out`` keeps the code that was used. ``taken``: the releases that rows have
    (column ``release``), from wherever they are cheapest to tell; a table parted by release then leaves the others unread.
    """
    if taken is not None:
        values = values.join(taken, "release", "left_semi")
    own = code_out or "__own"
    slim = values.select(F.col("release").alias("__release"), F.col("sa2_code").alias("__code"), *[F.col(f"`{c}`").alias(n) for n, c in columns.items()])
    keyed = rows.withColumn(own, edition_code(release, editions, codes, reference))
    joined = keyed.join(slim, (F.col(release) == F.col("__release")) & (F.col(own) == F.col("__code")), "left")
    return joined.drop("__release", "__code", *([] if code_out else [own]))
