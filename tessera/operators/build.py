"""Building tables: a schema declared first, rows checked against it, counters, and what the columns would occupy."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Scalar names, their Spark types, bytes a value, letters in titles, and the range of whole numbers.  Fixed values.
SCALARS = {
    "bool": (T.BooleanType(), 1, "O", None), "int8": (T.ByteType(), 1, "B", (-(2**7), 2**7 - 1)), "uint8": (T.ShortType(), 1, "b", (0, 2**8 - 1)),
    "int16": (T.ShortType(), 2, "S", (-(2**15), 2**15 - 1)), "uint16": (T.IntegerType(), 2, "s", (0, 2**16 - 1)), "int32": (T.IntegerType(), 4, "I", (-(2**31), 2**31 - 1)),
    "uint32": (T.LongType(), 4, "i", (0, 2**32 - 1)), "int64": (T.LongType(), 8, "L", (-(2**63), 2**63 - 1)), "uint64": (T.DecimalType(20, 0), 8, "l", (0, 2**64 - 1)),
    "float32": (T.FloatType(), 4, "F", None), "float64": (T.DoubleType(), 8, "D", None), "string": (T.StringType(), 0, "C", None),
}


@dataclass(frozen=True)
class Declared:
    name: str
    element: str
    length: int | None = None  # of a fixed array
    counter: str | None = None  # of a jagged array
    generated: bool = False

    @property
    def title(self) -> str:
        """``x/I``, ``mat[3]/D``, ``jag[njag]/F``."""
        dims = f"[{self.length}]" if self.length is not None else f"[{self.counter}]" if self.counter else ""
        return f"{self.name}{dims}/{SCALARS[self.element][2]}"


@dataclass
class TableBuilder:
    """A table under construction; columns are declared before the first rows come."""

    name: str
    title: str = ""
    basket_bytes: int = 32000
    columns: list[Declared] = field(default_factory=list)
    rows: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.basket_bytes <= 0:
            raise ValueError("basket_bytes must be positive")
        self.title = self.title or self.name

    def column(self, name: str, element: str, length: int | None = None, jagged: bool = False, count: str | None = None) -> TableBuilder:
        """Declare a scalar, an array of ``length``, or a jagged array whose counter is generated or shared."""
        if self.rows is not None:
            raise ValueError("columns are declared before the first rows")
        if element not in SCALARS:
            raise ValueError(f"{name}: no column of type {element}")
        if (length is not None or jagged) and element == "string":
            raise ValueError(f"{name}: arrays of strings are refused")
        if length is not None and length <= 0:
            raise ValueError(f"{name}: the length must be positive")
        if not jagged:
            return self._declare(Declared(name, element, length))
        if count is None:
            self._declare(Declared(f"n{name}", "int32", generated=True), name)
            return self._declare(Declared(name, element, counter=f"n{name}"))
        shared = next((c for c in self.columns if c.name == count), None)
        if shared is None or (shared.element, shared.length, shared.counter) != ("int32", None, None):
            raise ValueError(f"{name}: the counter {count} must be a declared int32 scalar")
        return self._declare(Declared(name, element, counter=count))

    def _declare(self, new: Declared, for_: str | None = None) -> TableBuilder:
        taken = {c.name for c in self.columns}
        if {new.name, for_} & taken:
            raise ValueError(f"there is a column {new.name if new.name in taken else for_}")
        self.columns.append(new)
        return self

    @property
    def schema(self) -> T.StructType:
        out = T.StructType()
        for c in self.columns:
            kind = SCALARS[c.element][0]
            meta = {"leaf": SCALARS[c.element][2], "title": c.title} | ({"len": c.length} if c.length is not None else {}) | ({"counter": c.counter} if c.counter else {})
            out.add(T.StructField(c.name, kind if c.length is None and c.counter is None else T.ArrayType(kind, False), True, meta))
        return out

    def append(self, rows: DataFrame) -> TableBuilder:
        """Add rows: every declared column must be there, other columns are ignored, values must fit exactly."""
        if not self.columns:
            raise ValueError("a table needs a column")
        lacking = [c.name for c in self.columns if not c.generated and c.name not in rows.columns]
        if lacking:
            raise ValueError(f"missing columns: {', '.join(lacking)}")
        checked = rows.select(*[self._checked(c, rows.schema).alias(c.name, metadata=self.schema[c.name].metadata) for c in self.columns])
        self.rows = checked if self.rows is None else self.rows.unionByName(checked)
        return self

    def _checked(self, c: Declared, given: T.StructType) -> Column:
        if c.generated:
            return F.size(c.name[1:]).cast("int")
        kind = given[c.name].dataType
        if c.length is None and c.counter is None:
            if isinstance(kind, T.ArrayType):
                raise ValueError(f"{c.name}: a scalar column, not an array")
            return exact(F.col(c.name), c.element, kind, c.name)
        if not isinstance(kind, T.ArrayType):
            raise ValueError(f"{c.name}: an array column, not a scalar")
        n = F.lit(c.length) if c.length is not None else F.size(c.name) if c.counter == f"n{c.name}" else F.col(c.counter)
        values = F.transform(c.name, lambda x: exact(x, c.element, kind.elementType, c.name))
        return F.when(F.size(c.name) == n, values).otherwise(F.raise_error(F.lit(f"{c.name}: an array of another length than declared")))

    def baskets(self) -> DataFrame:
        """(pos, column, entries, bytes, rows_per_basket, baskets) of the columns of fixed width."""
        sums = []
        for c in self.columns:
            width = SCALARS[c.element][1] * (c.length or 1)
            if c.element == "string":
                sums.append(F.sum(F.when(F.octet_length(c.name) < 255, F.octet_length(c.name) + 1).otherwise(F.octet_length(c.name) + 5)))
            else:
                sums.append(F.sum(F.size(c.name) * width) if c.counter else F.count(c.name) * width)
        one = self.rows.agg(F.count("*").alias("entries"), F.array(*[s.cast("long") for s in sums]).alias("bytes"))
        names = F.array(*[F.lit(c.name) for c in self.columns])
        width = F.array(*[F.lit(0 if c.element == "string" or c.counter else SCALARS[c.element][1] * (c.length or 1)) for c in self.columns])
        each = one.select("entries", F.posexplode(F.arrays_zip(names.alias("column"), F.col("bytes"), width.alias("width"))).alias("pos", "c"))
        rows = F.when(F.col("c.width") > 0, F.ceil(F.lit(self.basket_bytes) / F.col("c.width"))).cast("long")
        out = each.select("pos", F.col("c.column").alias("column"), "entries", F.col("c.bytes").alias("bytes"), rows.alias("rows_per_basket"))
        return out.withColumn("baskets", F.ceil(F.col("entries") / F.col("rows_per_basket")).cast("long"))

    def titles(self) -> list[str]:
        return [c.title for c in self.columns]


def exact(value: Column, element: str, given: T.DataType, name: str) -> Column:
    """A value in its declared type; a fraction, or a number out of range, fails the query where a cast would cut it."""
    kind, _, _, limits = SCALARS[element]
    if limits is None or isinstance(given, (T.StringType, T.BooleanType)):
        return value.cast(kind)
    low, high = limits
    if isinstance(given, (T.DoubleType, T.FloatType)):
        # Whole doubles up to 2 ** 53 are exact; above, the next double below the end of the range is.
        bad = (value != F.floor(value)) | (value < float(low)) | ((value > float(high)) if high < 2**53 else (value >= float(high + 1)))
    elif isinstance(given, T.DecimalType):
        bad = (value != F.floor(value)) | (value < F.lit(low).cast("decimal(20,0)")) | (value > F.lit(str(high)).cast("decimal(20,0)"))
    else:  # whole numbers of 8 bytes at most
        bad = (value < low) | (value > min(high, 2**63 - 1))
    return F.when(bad, F.raise_error(F.lit(f"{name}: a value does not fit {element}"))).otherwise(value.cast(kind))


def one_shot(columns: DataFrame, kinds: dict[str, str], name: str = "table", lengths: dict[str, int] | None = None) -> TableBuilder:
    """A table from whole columns; arrays become jagged columns, or of a fixed length where ``lengths`` gives one."""
    builder, lengths = TableBuilder(name), lengths or {}
    if lacking := [c for c in kinds if c not in columns.columns]:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    for c, element in kinds.items():
        builder.column(c, element, length=lengths.get(c), jagged=c not in lengths and isinstance(columns.schema[c].dataType, T.ArrayType))
    return builder.append(columns)
