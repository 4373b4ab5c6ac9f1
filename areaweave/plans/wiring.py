"""A configuration and a folder of files to the sources of a run."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.operators.geocode import CachedProvider, CorpusProvider, Paced, Provider
from areaweave.plans.config import Config
from areaweave.plans.loaders import Store, registry_of
from areaweave.plans.pipeline import Sources
from areaweave.sources import corpus
from areaweave.sources.editions import YEARS, edition
from areaweave.sources.files import stored


#: Environment variable that names a data pack of one's own.
LOCAL_ZIP = "AREAWEAVE_DATAPACK_ZIP"


def corpus_root(config: Config, root: str) -> str:
    """Where the address corpus lies: in the folder, or at the configured store."""
    d = config.data_sources
    if config.geocoding.gnaf.mode == "remote":
        if not d.corpus_base_url:
            raise ValueError("mode remote needs data_sources.corpus_base_url")
        return f"{d.corpus_base_url.rstrip('/')}/{d.corpus_release_prefix}".rstrip("/")
    return f"{root}/gnaf"


def providers_of(spark: SparkSession, config: Config, root: str, cache: str | None, fetch, dated: bool, ask=None, askers: int = 1) -> tuple[list[Provider], list[str]]:
    """The geocoders in their configured order, and the releases of the corpus that rows may choose from.

    ``ask``: one request to the outside geocoder (see `geocode.Paced`), which is kept to the configured pace.
    """
    g, out, releases = config.geocoding, [], []
    if fetch is None and ask is not None:
        fetch = Paced(ask, g.nominatim.rate_limit_per_second)
    for name in g.usable():
        if name == "gnaf":
            at = corpus_root(config, root)
            read = lambda r: corpus.read(spark, at, r, g.gnaf.mode, config.census.year, config.data_sources.corpus_name_filter or None, f"{root}/gnaf")  # noqa: B023, E731
            if dated and g.gnaf.release == "latest":
                releases = corpus.releases(spark, at, f"{root}/gnaf")
                if not releases:
                    raise FileNotFoundError(f"no release under {at}")
                every: DataFrame | None = None
                for r in releases:
                    one = read(r).withColumn("release", F.lit(r))
                    every = one if every is None else every.unionByName(one)
                out.append(CorpusProvider(every, g.gnaf.fuzzy_threshold, by_release=True))
            else:
                out.append(CorpusProvider(read(g.gnaf.release), g.gnaf.fuzzy_threshold))
        else:
            path = cache if g.cache_enabled and cache else None
            if fetch is not None or (path and stored(spark, path)):
                out.append(CachedProvider(fetch=fetch, path=path, askers=askers))
    return out, releases


def sources_of(spark: SparkSession, config: Config, root: str, cache: str | None = None, fetch=None, ask=None, askers: int = 1) -> Sources:
    """Boundaries, datasets, geocoders and mesh blocks of a run; only what the configuration asks for is looked up."""
    c, d = config.census, config.data_sources
    store = Store(spark, root.rstrip("/"), c.year, c.datum, descriptor=c.descriptor, region=c.region, local_zip=os.environ.get(LOCAL_ZIP), boundaries_base=d.boundaries_base_url or None, census_base=d.datapacks_base_url or None, lga_base=d.lga_base_url or None)
    boundaries = {c.asgs_edition: store.sa2}
    if config.input.date_column:
        for year, n in YEARS.items():
            if n not in boundaries and stored(spark, store.boundary_source(edition(year, "GDA94" if year < 2021 else c.datum))):
                boundaries[n] = store.boundary_table(year)
    given, releases = providers_of(spark, config, store.root, cache, fetch, config.input.date_column is not None, ask, askers) if config.input.address_column else ([], [])
    return Sources(boundaries, registry_of(store), given, store.mesh if config.input.address_column else None, corpus_releases=releases)
