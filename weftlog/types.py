"""The seven column types, fields and schemas, and their Spark equivalents. Schemas are fixed and supplied by the caller."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type names in the order of their persisted ids, which begin at 1 (fixed values).
TYPE_NAMES = ("Int32", "Int64", "Float", "Double", "Bool", "String", "Blob")
SPARK = {"Int32": T.IntegerType(), "Int64": T.LongType(), "Float": T.FloatType(), "Double": T.DoubleType(), "Bool": T.BooleanType(), "String": T.StringType(), "Blob": T.BinaryType()}
#: Bytes of a value; None for those of variable length.
WIDTH = {"Int32": 4, "Int64": 8, "Float": 4, "Double": 8, "Bool": 1, "String": None, "Blob": None}
#: struct and numpy codes of the fixed-width types, little-endian.
CODE = {"Int32": "<i4", "Int64": "<i8", "Float": "<f4", "Double": "<f8", "Bool": "|u1"}


class SchemaError(ValueError):
    """Columns that aren't those of the table's schema, or values that it can't hold."""


@dataclass(frozen=True)
class Field:
    name: str
    type: str

    def __post_init__(self):
        if self.type not in SPARK:
            raise SchemaError(f"{self.type} is no column type")


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...]

    @classmethod
    def of(cls, **columns: str) -> Schema:
        return cls(tuple(Field(n, t) for n, t in columns.items()))

    @classmethod
    def from_spark(cls, struct: T.StructType) -> Schema:
        names = {type(v): k for k, v in SPARK.items()}
        for f in struct:
            if type(f.dataType) not in names:
                raise SchemaError(f"{f.name}: {f.dataType.simpleString()} has no column type")
        return cls(tuple(Field(f.name, names[type(f.dataType)]) for f in struct))

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, SPARK[f.type], True) for f in self.fields])

    def fitted(self, projection: list[int] | None) -> list[int]:
        """The projection as given (None: every column); IndexError for an index that the schema doesn't have."""
        if projection is None:
            return list(range(len(self.fields)))
        for i in projection:
            if not 0 <= i < len(self.fields):
                raise IndexError(f"column {i} of {len(self.fields)}")
        return list(projection)

    def check(self, df: DataFrame) -> None:
        """SchemaError unless df has exactly these columns, by name, type and order."""
        found = [(f.name, f.dataType) for f in df.schema]
        if found != [(f.name, SPARK[f.type]) for f in self.fields]:
            raise SchemaError(f"expected {self.spark().simpleString()}, got {df.schema.simpleString()}")

    def strict(self, df: DataFrame) -> DataFrame:
        """df with a test in every column that its values aren't null: the table has no nulls."""
        self.check(df)
        return df.select(*[F.coalesce(F.col(f"`{f.name}`"), F.raise_error(F.lit(f"null in {f.name}")).cast(SPARK[f.type])).alias(f.name) for f in self.fields])

    def json(self) -> list[list[str]]:
        return [[f.name, f.type] for f in self.fields]

    @classmethod
    def from_json(cls, data: list[list[str]]) -> Schema:
        return cls(tuple(Field(n, t) for n, t in data))
