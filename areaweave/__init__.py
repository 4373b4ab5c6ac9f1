"""Location augmentation analytics on Spark."""

from areaweave.operators.geocode import Provider
from areaweave.operators.summary import RunSummary
from areaweave.plans.config import CensusConfig, Config, CorpusConfig, DataSourcesConfig, GeocodingConfig, InputConfig, NetworkConfig, OutputConfig, TemporalConfig, load_config
from areaweave.plans.pipeline import AugmentResult, Pipeline, Sources
from areaweave.plans.registry import CatalogError, Registry, VariableCatalog

__all__ = [
    "AugmentResult", "CatalogError", "CensusConfig", "Config", "CorpusConfig", "DataSourcesConfig", "GeocodingConfig", "InputConfig", "NetworkConfig",
    "OutputConfig", "Pipeline", "Provider", "Registry", "RunSummary", "Sources", "TemporalConfig", "VariableCatalog", "load_config",
]
