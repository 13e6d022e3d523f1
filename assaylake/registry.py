"""Endpoint registry: what is predicted, from which kind of input, in which units."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, types as T

BINARY, MULTICLASS, REGRESSION = "binary", "multiclass", "regression"
SEQUENCE, MOLECULAR = "sequence", "molecular"
IDENTITY, LOG10 = "identity", "log10"

# They define the results.
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
PREPARED_MIN_LEN, PREPARED_MAX_LEN = 4, 120
SCORING_MIN_LEN = 3
SEQUENCE_EMBEDDING_DIM, MOLECULE_EMBEDDING_DIM, SMALL_EMBEDDING_DIM = 1152, 768, 384
FINGERPRINT_BITS = 2048
SEQUENCE_FEATURES = 428
MOLECULE_FEATURES = 2265
FLOOR, FLOOR_TOLERANCE, REGION_CUT = -10.0, 1e-6, -6.0
TRAIN_FRACTION, VAL_FRACTION = 0.70, 0.10
RATE_CLASSES = 5
HUBER_DELTA = 1.0
FAMILY_THRESHOLD, FAMILY_K = 0.35, 3
MAX_POSITIVE_WEIGHT, MIN_POSITIVE_RATE = 20.0, 1e-4


@dataclass(frozen=True)
class Endpoint:
    name: str
    kind: str
    modality: str
    key_column: str
    label_column: str
    transform: str = IDENTITY
    raw_unit: str = ""
    embedding_dim: int = 0
    description: str = ""

    @property
    def unit(self) -> str:
        return "P(positive)" if self.kind == BINARY else self.raw_unit

    @property
    def input_dim(self) -> int:
        base = SEQUENCE_FEATURES if self.modality == SEQUENCE else MOLECULE_FEATURES
        return base + self.embedding_dim

    def __post_init__(self):
        if self.transform not in (IDENTITY, LOG10):
            raise ValueError(f"{self.name}: unsupported target transform {self.transform!r}")
        if self.kind not in (BINARY, MULTICLASS, REGRESSION):
            raise ValueError(f"{self.name}: unknown kind {self.kind!r}")
        if self.modality not in (SEQUENCE, MOLECULAR):
            raise ValueError(f"{self.name}: unknown modality {self.modality!r}")


# Endpoint names, source columns and units.
ENDPOINTS = (
    Endpoint("Hemolysis", BINARY, SEQUENCE, "sequence_std", "label",
             embedding_dim=SEQUENCE_EMBEDDING_DIM, description="hemolytic (1) or not (0)"),
    Endpoint("Half_life", REGRESSION, SEQUENCE, "sequence", "half_life_seconds", LOG10, "seconds",
             embedding_dim=SEQUENCE_EMBEDDING_DIM, description="plasma half-life"),
    Endpoint("Caco2", REGRESSION, MOLECULAR, "SMILES", "Permeability", IDENTITY, "logPapp",
             embedding_dim=MOLECULE_EMBEDDING_DIM, description="apparent permeability, cell layer"),
    Endpoint("PAMPA_MDCK", REGRESSION, MOLECULAR, "SMILES", "PAMPA", IDENTITY, "logPapp",
             embedding_dim=MOLECULE_EMBEDDING_DIM, description="apparent permeability, artificial membrane"),
)
BY_NAME = {e.name: e for e in ENDPOINTS}


def endpoint(name: str) -> Endpoint:
    if name not in BY_NAME:
        raise ValueError(f"unknown endpoint {name!r}; valid: {sorted(BY_NAME)}")
    return BY_NAME[name]


def resolve(names=None) -> tuple[Endpoint, ...]:
    """The named endpoints in the given order, or all of them."""
    return ENDPOINTS if names is None else tuple(endpoint(n) for n in names)


def endpoints_frame(spark: SparkSession, names=None) -> DataFrame:
    """The registry as a small table: one row per endpoint, so its size is bounded by the registry."""
    schema = T.StructType([
        T.StructField("endpoint", T.StringType(), False), T.StructField("kind", T.StringType(), False),
        T.StructField("modality", T.StringType(), False), T.StructField("transform", T.StringType(), False),
        T.StructField("unit", T.StringType(), False), T.StructField("input_dim", T.IntegerType(), False)])
    rows = [(e.name, e.kind, e.modality, e.transform, e.unit, e.input_dim) for e in resolve(names)]
    return spark.createDataFrame(rows, schema)
