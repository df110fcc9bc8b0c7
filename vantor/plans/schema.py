"""Declared collections: vector and scalar fields, their kinds, validation, and their Spark schema."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from enum import StrEnum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vantor.operators.errors import InvalidIndexKind, InvalidMetric, InvalidName, InvalidQuantization, InvalidSchema


class _Named(StrEnum):
    @classmethod
    def parse(cls, name: str):
        """Takes the serialised spelling too, which has an underscore more for some."""
        low = name.lower()
        try:
            return cls({"dot_product": "dot", "p_q": "pq", "ivf_p_q": "ivf_pq"}.get(low, low))
        except ValueError as e:
            unknown = {"DistanceMetric": InvalidMetric, "IndexKind": InvalidIndexKind, "Quantization": InvalidQuantization}.get(cls.__name__, InvalidName)
            raise unknown(f"{name!r} is none of {', '.join(cls)}") from e


class DistanceMetric(_Named):
    COSINE = "cosine"
    L2 = "l2"
    DOT = "dot"
    HAMMING = "hamming"


class Quantization(_Named):
    NONE = "none"
    SQ8 = "sq8"
    SQ4 = "sq4"
    BINARY = "binary"
    PQ = "pq"

    @property
    def compression_ratio(self) -> float:
        return {"none": 1.0, "sq8": 4.0, "sq4": 8.0, "binary": 32.0, "pq": 4.0}[self.value]


class IndexKind(_Named):
    FLAT = "flat"
    HNSW = "hnsw"
    IVF = "ivf"
    IVF_PQ = "ivf_pq"
    VAMANA = "vamana"
    PAGED = "paged"

    @property
    def supports_quantization(self) -> bool:
        return self.value in ("ivf", "ivf_pq", "vamana", "hnsw")


class ScalarKind(_Named):
    STR = "str"
    INT = "int"
    FLOAT = "float"
    BOOL = "bool"


class ScalarIndex(_Named):
    AUTO = "auto"
    SORTED_ARRAY = "sorted_array"
    B_TREE = "b_tree"
    HASH = "hash"
    FULL_TEXT = "full_text"
    GEO = "geo"


SCALAR_TYPES: dict[ScalarKind, T.DataType] = {ScalarKind.STR: T.StringType(), ScalarKind.INT: T.LongType(), ScalarKind.FLOAT: T.DoubleType(), ScalarKind.BOOL: T.BooleanType()}


@dataclass(frozen=True)
class VectorField:
    name: str
    dimension: int
    metric: DistanceMetric = DistanceMetric.L2
    index_type: IndexKind = IndexKind.HNSW
    quantization: Quantization = Quantization.NONE


@dataclass(frozen=True)
class ScalarField:
    name: str
    data_type: ScalarKind
    indexed: bool = False
    index_type: ScalarIndex = ScalarIndex.AUTO


@dataclass(frozen=True)
class CollectionConfig:
    """Only a declaration: what is declared beyond names, types and dimensions is kept as metadata."""

    name: str
    vectors: tuple[VectorField, ...] = field(default=())
    scalar_fields: tuple[ScalarField, ...] = field(default=())

    def with_vector(self, *fields: VectorField) -> CollectionConfig:
        return CollectionConfig(self.name, (*self.vectors, *fields), self.scalar_fields)

    def with_scalar(self, *fields: ScalarField) -> CollectionConfig:
        return CollectionConfig(self.name, self.vectors, (*self.scalar_fields, *fields))

    def vector(self, name: str | None = None) -> VectorField | None:
        """A vector field; the first one without a name."""
        return next((f for f in self.vectors if name in (None, f.name)), None)

    def scalar(self, name: str) -> ScalarField | None:
        return next((f for f in self.scalar_fields if f.name == name), None)

    @property
    def total_dimensions(self) -> int:
        return sum(f.dimension for f in self.vectors)

    def problem(self) -> str | None:
        """The first rule that is broken: some vector field; distinct names and positive dimensions, field by field; distinct scalar names."""
        if not self.vectors:
            return "Collection must have at least one vector field"
        seen: set[str] = set()
        for f in self.vectors:
            if f.name in seen:
                return f"Duplicate vector field name: {f.name}"
            if f.dimension <= 0:
                return f"Vector field '{f.name}' has invalid dimension {f.dimension}"
            seen.add(f.name)
        names = [f.name for f in self.scalar_fields]
        twice = next((n for i, n in enumerate(names) if n in names[:i]), None)
        return None if twice is None else f"Duplicate scalar field name: {twice}"

    def validate(self) -> CollectionConfig:
        if problem := self.problem():
            raise InvalidSchema(problem)
        return self

    def struct(self) -> T.StructType:
        """id, a float array for each vector field, a typed column for each scalar, and the payload."""
        out = [T.StructField("id", T.LongType(), False)]
        out += [T.StructField(f.name, T.ArrayType(T.FloatType(), False), True, {"dimension": f.dimension, "metric": str(f.metric), "index_type": str(f.index_type), "quantization": str(f.quantization)}) for f in self.vectors]
        out += [T.StructField(f.name, SCALAR_TYPES[f.data_type], True, {"indexed": f.indexed, "index_type": str(f.index_type)}) for f in self.scalar_fields]
        return T.StructType([*out, T.StructField("payload", T.VariantType())])

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> CollectionConfig:
        d = json.loads(text)
        vectors = tuple(VectorField(v["name"], v["dimension"], DistanceMetric.parse(v["metric"]), IndexKind.parse(v["index_type"]), Quantization.parse(v["quantization"])) for v in d["vectors"])
        return cls(d["name"], vectors, tuple(ScalarField(s["name"], ScalarKind.parse(s["data_type"]), s["indexed"], ScalarIndex.parse(s["index_type"])) for s in d["scalar_fields"]))

    def describe(self, spark: SparkSession) -> DataFrame:
        """(collection, field, kind, data_type, dimension, metric, index_type, quantization), a row for each field."""
        rows = [(self.name, f.name, "vector", "array<float>", f.dimension, str(f.metric), str(f.index_type), str(f.quantization)) for f in self.vectors]
        rows += [(self.name, f.name, "scalar", str(f.data_type), None, None, str(f.index_type) if f.indexed else None, None) for f in self.scalar_fields]
        return spark.createDataFrame(rows, "collection string, field string, kind string, data_type string, dimension int, metric string, index_type string, quantization string")
