"""Addresses to coordinates: a cascade of exact, component and fuzzy matches, with a cache of outside results.

A corpus has ``pid, label, lat, lon, mb_code, postcode``. Distinct addresses are resolved once and joined back; each
tier sees only what the tiers before it left, and every choice among equals goes to the least ``pid``.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.functions.address import cache_key, normalize_address, parse_address
from areaweave.functions.columns import once
from areaweave.functions.fuzzy import Labels
from areaweave.sources.files import stored

#: Reliability order of coordinate sources.
SOURCES = ("input", "gnaf_exact", "gnaf_component", "gnaf_fuzzy", "nominatim_cache", "nominatim_fresh", "failed")
RESULT = ("lat", "lon", "geo_source", "match_score", "mb_code", "pid")


class Provider(Protocol):
    """Adds RESULT columns to the addresses it can resolve; others have no row. Rows come with ``norm`` (and ``release``)."""

    def resolve(self, addresses: DataFrame) -> DataFrame: ...


def corpus_from_files(raw: DataFrame, census_year: int = 2021) -> DataFrame:
    """The corpus of per-locality files: label put together from its parts, decimals as doubles, mesh block by year."""
    label = F.concat_ws(" ", "address", "locality_name", "state", "postcode")
    return raw.select(
        F.col("gnaf_pid").cast("string").alias("pid"), label.alias("label"), F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lon"),
        F.col(f"mb_{census_year}_code").cast("string").alias("mb_code"), F.col("postcode").cast("string").alias("postcode"),
    )


def _picked(df: DataFrame, keys: list[str], source: str, score: bool = False) -> DataFrame:
    value = F.col("score") if score else F.lit(None).cast("double")
    return df.select(*keys, "lat", "lon", F.lit(source).alias("geo_source"), value.alias("match_score"), "mb_code", "pid")


def exact(addresses: DataFrame, corpus: DataFrame, keys: list[str]) -> DataFrame:
    """Labels equal to the normalised address; of several the least id."""
    on = (F.col("norm") == F.col("label")) & (F.col("release") == F.col("c_release") if "release" in keys else F.lit(True))
    hits = addresses.join(_labels(corpus, keys, []), on)
    best = hits.groupBy(*keys).agg(F.min("least").alias("b"))
    return _picked(best.select(*keys, "b.*"), keys, "gnaf_exact")


#: Letters of a token that lead to labels where no whole token is known.
START = 3


def component(addresses: DataFrame, corpus: DataFrame, keys: list[str]) -> DataFrame:
    """The only label of the postcode that holds number, name and type of the address; none if there are several."""
    p = F.col("parsed")
    name = F.split(p["street_name"], " ")
    # a token with blanks on both sides in the text has to be a token of the label: the longest one says most; without a
    # street type the name ends the text, so a label may go on within its last token
    inner = F.when(p["street_type"].isNotNull(), name).otherwise(F.slice(name, F.lit(1), F.size(name) - 1))
    token = F.array_max(F.transform(inner, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    # a name of one word that ends the text is the start of a token
    start = F.when(F.length(p["street_name"]) >= START, F.concat(F.lit("^"), F.substring(p["street_name"], 1, START)))
    token = F.coalesce(token, F.when(F.size(name) == 1, start), F.lit(""))
    rows = addresses.where(p["street_number"].isNotNull() & p["street_name"].isNotNull() & p["postcode"].isNotNull())
    # worked out once for each address: left to itself, the join would parse it again for every label
    wanted = F.concat_ws(" ", p["street_number"], p["street_name"], p["street_type"])
    rows = rows.select(*keys, p["postcode"].alias("__code"), wanted.alias("__wanted"), token.alias("__token")).distinct()
    # only labels of postcodes that are asked for are taken apart
    near = _labels(corpus, keys).join(rows.select(F.col("__code").alias("postcode")).distinct(), "postcode", "left_semi")
    words = F.split("label", " ")
    starts = F.transform(F.filter(words, lambda t: F.length(t) >= START), lambda t: F.concat(F.lit("^"), F.substring(t, 1, START)))
    by_token = near.withColumn("__of", F.explode(F.array_distinct(F.concat(words, starts, F.array(F.lit(""))))))
    on = (F.col("__code") == F.col("postcode")) & (F.col("__token") == F.col("__of")) & (F.col("release") == F.col("c_release") if "release" in keys else F.lit(True))
    # a label has many tokens, which its size as Spark estimates it knows nothing of: never broadcast
    hits = rows.join(by_token.hint("merge"), on).where(F.contains("label", F.col("__wanted")))
    one = hits.groupBy(*keys).agg(F.sum("held").alias("n"), F.first("least").alias("b")).where("n = 1")
    return _picked(one.select(*keys, "b.*"), keys, "gnaf_component")


#: Addresses, and labels, of one postcode (or locality) that are compared in one go; more of either are dealt to several tasks.
ADDRESSES, LABELS = 2000, 20_000


def fuzzy(addresses: DataFrame, corpus: DataFrame, keys: list[str], threshold: float = 0.85) -> DataFrame:
    """The most similar label of the postcode, or of labels that name the locality where there is no postcode.

    Equal labels of a postcode are one, that of the least id. In the second case labels are found by the first two words of the locality (the only one, if it has one), which a
    label has to hold, so ``MOUNT`` alone leads nowhere. The labels of a key are dealt to shards of `LABELS` and its addresses
    to parts of `ADDRESSES`; a task has one of each, an inverted index of the shard's tokens bounds what its labels are
    worth (see `functions.fuzzy.Labels`), and the best of an address over all shards is merged. Pairs never become rows.
    """
    p = F.col("parsed")
    release = [F.col("release")] if "release" in keys else []
    at = F.when(p["postcode"].isNotNull(), F.concat(F.lit("P"), p["postcode"])).otherwise(F.concat(F.lit("L"), F.substring_index(p["locality"], " ", 2)))
    rows = addresses.select(*keys, at.alias("__k"), F.when(p["postcode"].isNull(), p["locality"]).alias("__locality")).where("__k is not null").distinct()
    rows = rows.withColumn("__k", F.concat_ws("|", "__k", *release))
    words = F.filter(F.split("label", " "), lambda t: t != "")
    couples = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda x, y: F.concat_ws(" ", x, y))
    named = F.transform(F.concat(words, couples), lambda t: F.concat(F.lit("L"), t))
    found_by = F.array_distinct(F.concat(F.array(F.concat(F.lit("P"), "postcode")), named))
    labels = _labels(corpus, keys).withColumn("__k", F.explode(found_by)).where("__k is not null")
    labels = labels.withColumn("__k", F.concat_ws("|", "__k", *([F.col("c_release")] if release else [])))
    parts = rows.groupBy("__k").agg(F.ceil(F.count("*") / ADDRESSES).cast("int").alias("__parts"))
    wanted = labels.hint("merge").join(parts, "__k").select("__k", "__parts", "label", "least.*")
    shards = wanted.groupBy("__k").agg(F.ceil(F.count("*") / LABELS).cast("int").alias("__shards"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = rows.join(parts, "__k").join(shards, "__k")
    dealt = dealt.select("__k", F.pmod(F.xxhash64("norm"), F.col("__parts").cast("long")).cast("int").alias("__part"), every("__shards").alias("__shard"), *keys, "__locality")
    sent = wanted.join(shards, "__k").withColumn("__shard", F.pmod(F.xxhash64("pid", "label"), F.col("__shards").cast("long")).cast("int"))
    sent = sent.select("__k", every("__parts").alias("__part"), "__shard", "pid", "label", "lat", "lon", "mb_code")

    def best(left, right):
        import pyarrow as pa

        known = Labels(right.column("label").to_pylist(), right.column("pid").to_pylist())
        columns = {k: left.column(k).to_pylist() for k in [*keys, "__locality"]}
        hits = [known.best(text, threshold, place) for text, place in zip(columns["norm"], columns["__locality"])]
        rows = [i for i, h in enumerate(hits) if h]
        taken = right.take(pa.array([hits[i][0] for i in rows], pa.int64()))
        made = [pa.array([columns[k][i] for i in rows], pa.string()) for k in keys] + [taken.column(c).combine_chunks() for c in ("lat", "lon", "mb_code", "pid")]
        return pa.table([*made, pa.array([hits[i][1] for i in rows], pa.float64())], names=[*keys, "lat", "lon", "mb_code", "pid", "score"])

    schema = ", ".join(f"{k} string" for k in keys) + ", lat double, lon double, mb_code string, pid string, score double"
    place = ["__k", "__part", "__shard"]
    found = dealt.groupBy(*place).cogroup(sent.groupBy(*place)).applyInArrow(best, schema)
    top = F.min(F.struct((-F.col("score")).alias("s"), F.col("pid").isNull().alias("none"), "pid", "lat", "lon", "mb_code", "score"))
    return _picked(found.groupBy(*keys).agg(top.alias("b")).select(*keys, "b.*"), keys, "gnaf_fuzzy", score=True)


def _labels(corpus: DataFrame, keys: list[str], apart: Sequence[str] = ("postcode",)) -> DataFrame:
    """``label, held, least`` (and ``postcode``, ``c_release``): a row for each label, the rows that hold it, and that of the least id.

    A corpus may hold a label any number of times, so nothing after this grows by copies; and its size is counted at
    run time, where an estimate from the corpus's files takes computed labels for smaller than they are.
    """
    one = ["label", *apart, *([F.col("release").alias("c_release")] if "release" in keys else [])]
    least = F.min(F.struct(F.col("pid").isNull().alias("none"), "pid", "lat", "lon", "mb_code")).alias("least")
    return corpus.where(F.col("label").isNotNull()).groupBy(*one).agg(F.count("*").alias("held"), least)


class CorpusProvider:
    """The three tiers over an address corpus; without a threshold, the first two.

    The addresses go through the tiers in one line of left joins, each flagged with what it has found so far; a tier
    sees the rows that have no flag yet. A tier's own rows are read again for it, but no tier before it is.
    """

    def __init__(self, corpus: DataFrame, threshold: float | None = 0.85, by_release: bool = False):
        if threshold is not None and not 0 <= threshold <= 1:
            raise ValueError("the fuzzy threshold lies between 0 and 1")
        self.corpus, self.threshold, self.keys = corpus, threshold, ["norm", "release"] if by_release else ["norm"]

    def resolve(self, addresses: DataFrame) -> DataFrame:
        keys = self.keys
        by_label = _labels(self.corpus, keys, []).where(~F.col("least.none")).withColumnRenamed("least", "b")
        on = (F.col("norm") == F.col("label")) & (F.col("release") == F.col("c_release") if "release" in keys else F.lit(True))
        rows = addresses.select(*keys).join(by_label, on, "left").select(*keys, "b")
        found = _picked(rows.where("b is not null").select(*keys, "b.*"), keys, "gnaf_exact")
        left = parse_address(rows.where("b is null").select(*keys), "norm").where(F.col("parsed").isNotNull())
        second = component(left, self.corpus, keys)
        if self.threshold is None:
            return found.unionByName(second)
        flagged = left.join(second.withColumnsRenamed({c: f"__{c}" for c in RESULT}), keys, "left")
        second = flagged.where("__geo_source is not null").select(*keys, *[F.col(f"__{c}").alias(c) for c in RESULT])
        third = fuzzy(flagged.where("__geo_source is null").select(*keys, "parsed"), self.corpus, keys, self.threshold)
        return found.unionByName(second).unionByName(third)


class Paced:
    """Asks an outside geocoder, one request at a time for each task, at a steady pace.

    ``ask(address)`` gives a status, headers and the parsed answer; it may raise ConnectionError or TimeoutError. After 429
    and 503 the request is repeated up to ``tries`` times, after the longer of what ``Retry-After`` says and 1, 2, 4 s.
    ``per_second`` is the pace of all askers together: `shared` gives each of them its part of it.
    """

    def __init__(self, ask: Callable[[str], tuple[int, dict, object]], per_second: float = 1.0, tries: int = 3, wait: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.ask, self.gap, self.tries, self.wait, self.clock = ask, 1.0 / per_second, tries, wait, clock

    def shared(self, askers: int) -> Paced:
        """The pace of one of several askers, so that all together keep to the pace of this one."""
        return Paced(self.ask, 1.0 / (self.gap * askers), self.tries, self.wait, self.clock)

    def __call__(self, addresses: Iterator[str]) -> Iterator[tuple[float, float] | None]:
        last: float | None = None
        for a in addresses:
            out = None
            for k in range(self.tries + 1):
                if last is not None and (rest := self.gap - (self.clock() - last)) > 0:
                    self.wait(rest)
                last = self.clock()
                try:
                    status, headers, answer = self.ask(a)
                except (ConnectionError, TimeoutError):
                    break
                if status in (429, 503) and k < self.tries:
                    self.wait(max(self.advised(headers), 2.0**k))
                    continue
                out = self.place(answer) if status < 400 else None
                break
            yield out

    @staticmethod
    def advised(headers: dict) -> float:
        """Seconds that ``Retry-After`` asks for; a date, or nothing, is no advice."""
        try:
            return max(float({k.lower(): v for k, v in headers.items()}.get("retry-after", 0)), 0.0)
        except ValueError:
            return 0.0

    @staticmethod
    def place(answer) -> tuple[float, float] | None:
        """Latitude and longitude of the first hit of an answer."""
        try:
            return float(answer[0]["lat"]), float(answer[0]["lon"])
        except (IndexError, KeyError, TypeError, ValueError):
            return None


class CachedProvider:
    """Results of an outside geocoder: a cache table by hash, and a callable for what it lacks.

    ``fetch`` takes an iterator of addresses and yields (lat, lon) or None for each; it runs on the executors, in ``askers``
    tasks at most, which share its pace if it is `Paced`. With ``path``, hits are added to the cache there before anything
    uses them, so each address is asked for once, however often the plan is run, and a second run asks for none of them.
    Failures are not kept.
    """

    def __init__(self, cache: DataFrame | None = None, fetch: Callable[[Iterator[str]], Iterator[tuple[float, float] | None]] | None = None, path: str | None = None, askers: int = 1):
        if askers < 1:
            raise ValueError("there has to be an asker")
        self.cache, self.fetch, self.path, self.askers = cache, fetch, path, askers

    def resolve(self, addresses: DataFrame) -> DataFrame:
        keys = [c for c in ("norm", "release") if c in addresses.columns]
        spark = addresses.sparkSession
        cache = read_cache(spark, self.path) if self.cache is None and self.path else self.cache
        if cache is None and self.fetch is None:
            raise ValueError("neither a cache nor a way to fetch")
        rows = addresses.select(*keys).withColumn("hash", cache_key(F.col("norm")))
        if self.path and self.fetch is not None:
            asked = rows if cache is None else rows.join(cache.select("hash"), "hash", "left_anti")
            batch = write_cache(self.fetched(asked.dropDuplicates(["hash"]), ["norm"]), self.path)
            known = read_cache(spark, self.path).withColumn("geo_source", F.when(F.col("batch") == batch, "nominatim_fresh").otherwise("nominatim_cache"))
            if self.cache is not None:
                known = known.join(self.cache.select("hash"), "hash", "left_anti").select("hash", "lat", "lon", "geo_source").unionByName(self.cache.select("hash", "lat", "lon", F.lit("nominatim_cache").alias("geo_source")))
            return _outside(rows.join(known, "hash"), keys)
        out = None
        if cache is not None:
            out = _outside(rows.join(cache.select("hash", "lat", "lon", F.lit("nominatim_cache").alias("geo_source")), "hash"), keys)
            rows = rows.join(cache.select("hash"), "hash", "left_anti")
        if self.fetch is not None:
            fresh = _outside(self.fetched(rows, keys), keys)
            out = fresh if out is None else out.unionByName(fresh)
        return out

    def fetched(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """``keys, lat, lon, geo_source`` of the addresses that the outside geocoder knows."""
        import pandas as pd

        fetch = self.fetch.shared(self.askers) if isinstance(self.fetch, Paced) else self.fetch

        def run(frames):
            for f in frames:
                got = list(fetch(iter(f["norm"])))
                f = f[keys].assign(lat=[g[0] if g else None for g in got], lon=[g[1] if g else None for g in got], geo_source="nominatim_fresh")
                yield f[f["lat"].notna()].astype({"lat": float, "lon": float}) if len(f) else pd.DataFrame(columns=f.columns)

        # as many tasks as there are askers, whatever the plan before: none of them is faster than its part of the pace
        dealt = rows.select(*keys).repartition(self.askers, F.xxhash64("norm"))
        return dealt.mapInPandas(run, ", ".join(f"{k} string" for k in keys) + ", lat double, lon double, geo_source string")


def _outside(found: DataFrame, keys: list[str]) -> DataFrame:
    none = F.lit(None).cast("string")
    return found.select(*keys, "lat", "lon", "geo_source", F.lit(None).cast("double").alias("match_score"), none.alias("mb_code"), none.alias("pid"))


CACHE = "hash string, lat double, lon double, batch string, part string"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """``hash, lat, lon, batch`` of a cache table, one row for each hash however often it was written; empty if there is none."""
    if not stored(spark, path):
        return spark.createDataFrame([], CACHE).drop("part")
    first = F.min(F.struct(F.coalesce("batch", F.lit("")).alias("batch"), "lat", "lon")).alias("b")
    return spark.read.schema(CACHE).option("basePath", path).parquet(path).groupBy("hash").agg(first).select("hash", "b.lat", "b.lon", "b.batch")


def write_cache(found: DataFrame, path: str) -> str:
    """Add fresh results (``norm, lat, lon, geo_source``) to a cache table, and the name of the batch they make.

    The table is parted by the first two letters of the hash. A batch becomes visible when its job has committed; a job
    that is repeated may write a hash again, which `read_cache` counts once.
    """
    batch = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    fresh = found.where("geo_source = 'nominatim_fresh'").select(cache_key(F.col("norm")).alias("hash"), "lat", "lon", F.lit(batch).alias("batch"))
    fresh.withColumn("part", F.substring("hash", 1, 2)).write.mode("append").partitionBy("part").parquet(path)
    return batch


def resolve(rows: DataFrame, address: str | None, lat: str | None, lon: str | None, providers: list[Provider], release: str | None = None) -> DataFrame:
    """Add ``geo_lat, geo_lon, geo_source, geo_match_score, mb_code`` to rows.

    A row's own coordinates come first, then its address through the providers in order, else it has failed.
    """
    own = F.lit(False) if lat is None else F.col(lat).isNotNull() & F.col(lon).isNotNull()
    text = normalize_address(F.col(address)) if address else F.lit("")
    rows = rows.withColumn("__own", own).withColumn("norm", once(F.when(~F.col("__own"), text)))
    keys = ["norm"]
    if release:
        rows, keys = rows.withColumn("release", F.col(release)), ["norm", "release"]
    number = lambda c: F.lit(None).cast("double") if c is None else F.col(c).cast("double")
    if address and providers:
        left = rows.where(F.col("norm") != "").select(*keys).distinct()
        found = None
        for p in providers:
            got = p.resolve(left)
            found = got if found is None else found.unionByName(got)
            left = left.join(got.select(*keys), keys, "left_anti")
        rows = rows.join(found.withColumnsRenamed({c: f"__{c}" for c in RESULT}), keys, "left")
    else:
        rows = rows.withColumns({f"__{c}": F.lit(None).cast("double" if c in ("lat", "lon", "match_score") else "string") for c in RESULT})
    out = rows.withColumns({
        "geo_lat": F.when(F.col("__own"), number(lat)).otherwise(F.col("__lat")),
        "geo_lon": F.when(F.col("__own"), number(lon)).otherwise(F.col("__lon")),
        "geo_source": F.when(F.col("__own"), "input").otherwise(F.coalesce("__geo_source", F.lit("failed"))),
        "geo_match_score": F.col("__match_score"),
        "mb_code": F.when(~F.col("__own"), F.col("__mb_code")),
    })
    return out.drop("__own", "norm", *(["release"] if release else []), *[f"__{c}" for c in RESULT])
