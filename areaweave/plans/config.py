"""What a run is to do."""

from __future__ import annotations

import re
from typing import Literal

import yaml
from pydantic import BaseModel, ConfigDict, Field, field_validator, model_validator

REF = re.compile(r"^[A-Za-z][A-Za-z0-9_]*\.[A-Za-z][A-Za-z0-9_]*$")
FRIENDLY = re.compile(r"^[a-z][a-z0-9_]*$")
PREFIX = re.compile(r"^[a-z0-9_]*$")


class _Strict(BaseModel):
    model_config = ConfigDict(extra="forbid")


class InputConfig(_Strict):
    path: str | None = None
    address_column: str | None = None
    latitude_column: str | None = None
    longitude_column: str | None = None
    date_column: str | None = None

    @model_validator(mode="after")
    def _locators(self):
        if (self.latitude_column is None) != (self.longitude_column is None):
            raise ValueError("latitude_column and longitude_column go together")
        if self.address_column is None and self.latitude_column is None:
            raise ValueError("an address column or a pair of coordinate columns is needed")
        return self


class OutputConfig(_Strict):
    path: str | None = None
    prefix: str = "sa2_"

    @field_validator("prefix")
    @classmethod
    def _prefix(cls, v: str) -> str:
        if not PREFIX.match(v):
            raise ValueError(f"prefix {v!r} may hold lower case letters, digits and underscores")
        return v


class CensusConfig(_Strict):
    year: Literal[2016, 2021] = 2021
    level: Literal["SA2"] = "SA2"
    profile: Literal["GCP"] = "GCP"
    region: Literal["AUS", "NSW", "VIC", "QLD", "SA", "WA", "TAS", "NT", "ACT", "OT"] = "AUS"
    descriptor: Literal["short-header", "sequential", "long-header"] = "short-header"
    asgs_edition: Literal[2, 3] = 3
    datum: Literal["GDA2020", "GDA94"] = "GDA2020"

    @model_validator(mode="after")
    def _consistent(self):
        if self.asgs_edition != {2021: 3, 2016: 2}[self.year]:
            raise ValueError(f"year {self.year} does not go with edition {self.asgs_edition}")
        if self.year == 2016 and self.datum != "GDA94":
            raise ValueError("boundaries of 2016 are published in GDA94 only")
        if self.year == 2016 and self.descriptor != "short-header":
            raise ValueError("tables of 2016 are published with short headers only")
        return self


class CorpusConfig(_Strict):
    mode: Literal["cache", "remote", "official"] = "cache"
    release: str = "latest"
    datum: Literal["GDA2020", "GDA94"] = "GDA2020"
    fuzzy_threshold: float = Field(0.85, ge=0, le=1)

    @field_validator("release")
    @classmethod
    def _release(cls, v: str) -> str:
        if v != "latest" and not re.fullmatch(r"\d{6}", v):
            raise ValueError("a release is latest or YYYYMM")
        return v


class NetworkConfig(_Strict):
    user_agent: str = ""
    rate_limit_per_second: float = Field(1.0, gt=0)


class GeocodingConfig(_Strict):
    providers: list[Literal["gnaf", "nominatim"]] = ["gnaf", "nominatim"]
    cache_enabled: bool = True
    gnaf: CorpusConfig = CorpusConfig()
    nominatim: NetworkConfig = NetworkConfig()

    @model_validator(mode="after")
    def _providers(self):
        if not self.providers or len(set(self.providers)) != len(self.providers):
            raise ValueError("providers are one or more, each once")
        if "nominatim" in self.providers and not self.nominatim.user_agent.strip():
            raise ValueError("the network provider needs a user agent")
        return self

    def usable(self) -> list[str]:
        """The providers in their order; the network one only if it says who asks."""
        return [p for p in self.providers if p != "nominatim" or self.nominatim.user_agent.strip()]


class ReleaseRule(_Strict):
    """A dataset's own rule: ``{resolution: closest}``."""

    resolution: Literal["closest_at_or_before", "closest"] | None = None


class TemporalConfig(_Strict):
    resolution: Literal["closest_at_or_before", "closest"] = "closest_at_or_before"
    out_of_range: Literal["fail", "nearest"] = "fail"
    reference_edition: Literal[1, 2, 3, 4] = 3
    per_dataset: dict[str, ReleaseRule] = {}

    def rule(self, dataset: str) -> str:
        """How a dataset's release is chosen: its own rule, else the general one."""
        own = self.per_dataset.get(dataset)
        return (own.resolution if own else None) or self.resolution


class DataSourcesConfig(_Strict):
    boundaries_base_url: str = ""
    datapacks_base_url: str = ""
    corpus_base_url: str = ""
    corpus_release_prefix: str = ""
    corpus_name_filter: str = ""
    lga_base_url: str = ""


class Config(_Strict):
    input: InputConfig
    output: OutputConfig = OutputConfig()
    census: CensusConfig = CensusConfig()
    data_sources: DataSourcesConfig = DataSourcesConfig()
    geocoding: GeocodingConfig = GeocodingConfig.model_construct()
    temporal: TemporalConfig = TemporalConfig()
    variables: dict[str, str]

    @field_validator("variables")
    @classmethod
    def _variables(cls, v: dict[str, str]) -> dict[str, str]:
        if not v:
            raise ValueError("at least one variable is needed")
        for name, ref in v.items():
            if not FRIENDLY.match(name) or not REF.match(ref):
                raise ValueError(f"variable {name}: {ref} does not look like name: NAMESPACE.field")
        return v

    @model_validator(mode="after")
    def _together(self):
        if self.census.year == 2016 and self.input.address_column and "gnaf" in self.geocoding.providers:
            raise ValueError("the address corpus has mesh blocks of 2021; use coordinates with year 2016")
        if self.input.date_column and self.temporal.reference_edition != self.census.asgs_edition:
            raise ValueError("the reference edition is that of the census year")
        return self

    def warnings(self) -> list[str]:
        out = []
        if self.input.address_column and self.census.datum != self.geocoding.gnaf.datum:
            out.append(f"boundaries are in {self.census.datum}, addresses in {self.geocoding.gnaf.datum}")
        return out


def load_config(text: str) -> Config:
    """A configuration from YAML text."""
    return Config.model_validate(yaml.safe_load(text) or {})
