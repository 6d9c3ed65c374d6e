"""Typed node and edge declarations, and their validation against DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark types that a property may have; nothing nested.
SCALARS = (T.StringType, T.IntegerType, T.LongType, T.ShortType, T.BooleanType, T.FloatType, T.DoubleType, T.DecimalType, T.TimestampType, T.TimestampNTZType, T.DateType, T.DayTimeIntervalType, T.BinaryType)


@dataclass(frozen=True)
class Property:
    name: str
    type: T.DataType
    required: bool = False
    max_length: int | None = None

    def field(self) -> T.StructField:
        return T.StructField(self.name, self.type, not self.required, {"max_length": self.max_length} if self.max_length else {})


@dataclass(frozen=True)
class Index:
    name: str
    columns: tuple[str, ...]
    unique: bool = False


@dataclass(frozen=True)
class Relationship:
    """A named way from an owner over an edge type to related nodes."""

    name: str
    owner: str
    edge: str
    related: str
    outgoing: bool = True
    many: bool = True


@dataclass(frozen=True)
class NodeType:
    name: str
    properties: tuple[Property, ...]
    key: str = "id"
    indexes: tuple[Index, ...] = ()

    def schema(self) -> T.StructType:
        keys = [p for p in self.properties if p.name == self.key] or [Property(self.key, T.LongType(), True)]
        return T.StructType([p.field() for p in [*keys, *(p for p in self.properties if p.name != self.key)]])


@dataclass(frozen=True)
class EdgeType:
    name: str
    source: str
    target: str
    properties: tuple[Property, ...] = ()
    indexes: tuple[Index, ...] = ()

    def schema(self) -> T.StructType:
        ends = [T.StructField(n, T.LongType(), False) for n in ("id", "from_id", "to_id")]
        return T.StructType(ends + [p.field() for p in self.properties])


class SchemaMismatch(ValueError):
    pass


@dataclass
class GraphModel:
    """An immutable registry of node types, edge types and relationships."""

    nodes: dict[str, NodeType] = field(default_factory=dict)
    edges: dict[str, EdgeType] = field(default_factory=dict)
    relationships: dict[tuple[str, str], Relationship] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for e in self.edges.values():
            for end in (e.source, e.target):
                if end not in self.nodes:
                    raise ValueError(f"edge type {e.name} ends at {end}, which is no node type")
        for r in self.relationships.values():
            e = self.edges[r.edge]
            if (r.owner, r.related) != ((e.source, e.target) if r.outgoing else (e.target, e.source)):
                raise ValueError(f"relationship {r.name} doesn't follow edge type {e.name}")

    def validate(self, name: str, df: DataFrame) -> list[str]:
        """What of a DataFrame differs from the declared type: missing columns and other types."""
        declared = (self.nodes.get(name) or self.edges[name]).schema()
        found = {f.name: f.dataType for f in df.schema.fields}
        out = [f"{f.name}: missing" for f in declared.fields if f.name not in found]
        return out + [f"{f.name}: {found[f.name].simpleString()} instead of {f.dataType.simpleString()}" for f in declared.fields if f.name in found and found[f.name] != f.dataType]

    def check(self, name: str, df: DataFrame) -> DataFrame:
        if wrong := self.validate(name, df):
            raise SchemaMismatch(f"{name}: {'; '.join(wrong)}")
        return df

    def unique_violations(self, name: str, df: DataFrame) -> DataFrame:
        """Values that a unique index or the key has more than once: index, n."""
        kind = self.nodes.get(name) or self.edges[name]
        keys = [Index("key", (kind.key if isinstance(kind, NodeType) else "id",), True), *(i for i in kind.indexes if i.unique)]
        parts = [df.groupBy(*i.columns).count().filter("count > 1").select(F.lit(i.name).alias("index"), F.col("count").alias("n")) for i in keys]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def create_script(self) -> str:
        """Statements that create an empty table for every type.

        Spark has no indexes: keys and unique indexes are written down as table properties
        (``unique_violations`` checks them).
        """
        out = []
        for kind in [*self.nodes.values(), *self.edges.values()]:
            cols = ", ".join(f"`{f.name}` {f.dataType.simpleString().upper()}{'' if f.nullable else ' NOT NULL'}" for f in kind.schema().fields)
            key = kind.key if isinstance(kind, NodeType) else "id"
            unique = {"key": key} | {i.name: ",".join(i.columns) for i in kind.indexes if i.unique}
            props = ", ".join(f"'unique.{n}'='{c}'" for n, c in unique.items())
            out.append(f"CREATE TABLE IF NOT EXISTS `{kind.name}` ({cols}) USING PARQUET TBLPROPERTIES ({props});")
        return "\n".join(out)

    def ensure_created(self, spark: SparkSession) -> None:
        for statement in self.create_script().split(";\n"):
            spark.sql(statement.rstrip(";"))
