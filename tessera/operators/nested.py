"""Nested values: structs put together from split columns, member-wise collections, pairs and bit sets."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def assemble(df: DataFrame, name: str, members: dict[str, str], prefix: str = "") -> DataFrame:
    """A struct column from split columns; a member's name loses its parents and its dimensions."""
    return df.withColumn(name, F.struct(*[F.col(c).alias(member_name(m, prefix)) for m, c in members.items()]))


def member_name(column: str, parent: str = "") -> str:
    """``parent.a.b[3]`` gives ``b``."""
    out = column.removeprefix(parent).lstrip(".") if parent else column
    return out.split("[")[0].rsplit(".", 1)[-1]


def join_split(parts: list[DataFrame]) -> DataFrame:
    """Split columns that hold ``entry`` put side by side: as many rows as the shortest has."""
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "entry")
    return out


def transposed(*columns: str) -> Column:
    """Member-wise lists as one list of structs, cut to the shortest list."""
    least = F.size(columns[0]) if len(columns) == 1 else F.least(*[F.size(c) for c in columns])
    return F.slice(F.arrays_zip(*columns), F.lit(1), least)


def memberwise(column: str, members: list[str]) -> dict[str, Column]:
    """A list of structs as one list a member."""

    def member(m: str) -> Column:
        return F.transform(column, lambda x: x[m])

    return {m: member(m) for m in members}


def pairs(keys: Column, values: Column) -> Column:
    """A map as an array of (first, second): repeated keys stay."""
    return F.zip_with(keys, values, lambda k, v: F.struct(k.alias("first"), v.alias("second")))


def pairs_of(entries: Column) -> Column:
    """An array of two-member structs as (first, second)."""
    return F.transform(entries, lambda x: F.struct(x["first"], x["second"]))


def as_map(pairs_: Column) -> Column:
    """A convenience for keys known to be unique; a repeated key fails the query."""
    return F.map_from_entries(pairs_)


def bits(value: Column, n: int) -> Column:
    """A whole number as n booleans, bit 0 first."""
    return F.array(*[F.shiftright(value, i).bitwiseAND(1) == 1 for i in range(n)])


def flattened(column: str, levels: int) -> Column:
    """A nested array of ``levels`` levels as one flat array."""
    out = F.col(column)
    for _ in range(levels - 1):
        out = F.flatten(out)
    return out


def reshaped(flat: Column, fixed: int) -> Column:
    """A flat counted array as arrays of ``fixed`` values each; the length must divide."""
    n = F.size(flat)
    rows = F.transform(F.sequence(F.lit(0), F.greatest((n / fixed).cast("int") - 1, F.lit(0))), lambda i: F.slice(flat, i * fixed + 1, F.lit(fixed)))
    return F.when(n % fixed != 0, F.raise_error(F.lit("length is no multiple of the fixed part"))).when(n == 0, F.array().cast("array<array<double>>")).otherwise(rows)


#: Scalar type names of stored classes and their Spark types; unsigned ones are one step wider.
SCALARS = {
    "bool": T.BooleanType(), "char": T.ByteType(), "signed char": T.ByteType(), "unsigned char": T.ShortType(), "short": T.ShortType(), "unsigned short": T.IntegerType(),
    "int": T.IntegerType(), "unsigned int": T.LongType(), "unsigned": T.LongType(), "long": T.LongType(), "long long": T.LongType(), "unsigned long": T.DecimalType(20, 0),
    "unsigned long long": T.DecimalType(20, 0), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(),
    "Float16_t": T.FloatType(), "Double32_t": T.DoubleType(),
}
SEQUENCES = ("vector", "list", "deque", "forward_list", "set", "multiset", "unordered_set", "unordered_multiset")
MAPS = ("map", "multimap", "unordered_map", "unordered_multimap")


@dataclass(frozen=True)
class TypeName:
    """A C++ type's name and its template arguments, without name spaces, qualifiers, pointers and references."""

    name: str
    arguments: tuple[TypeName, ...] = ()

    def __str__(self) -> str:
        """As stored classes spell it: no blank after a comma, one between closing brackets."""
        inner = ",".join(map(str, self.arguments))
        return f"{self.name}<{inner}{' ' if inner.endswith('>') else ''}>" if inner else self.name


def type_name(text: str) -> TypeName:
    """The parsed name; different spellings of one type are equal."""
    stack: list[tuple[str, list[TypeName]]] = [("", [])]

    def close() -> None:
        name, arguments = stack.pop()
        name = re.sub(r"\b(class|struct|enum|const|volatile)\s+|std::(__1::|__cxx11::)?|__gnu_cxx::", "", name)
        name = " ".join(re.sub(r"[*&\s]+$", "", re.sub(r"\s+const\s*$", "", name)).split())
        plain = name in ("string", "basic_string")  # its arguments say only that it is the usual one
        stack[-1][1].append(TypeName("string" if plain else name, () if plain else tuple(arguments)))

    stack.append(("", []))
    for token in re.findall(r"[<>,]|[^<>,]+", text):
        if token == "<":
            stack.append(("", []))
        elif token in ">,":
            if len(stack) < 3:
                raise ValueError(f"{text}: no bracket is open")
            close()
            if token == ",":
                stack.append(("", []))
        elif not stack[-1][1]:
            stack[-1] = (stack[-1][0] + token, stack[-1][1])
    if len(stack) != 2:
        raise ValueError(f"{text}: a bracket stays open")
    close()
    return stack[0][1][0]


def spark_type(name: str | TypeName, classes: dict[str, list[tuple[str, str]]] | None = None) -> T.DataType:
    """The Spark type of a C++ type name: sequences and sets are arrays, maps arrays of (first, second), bit sets boolean arrays.

    ``classes`` gives the (member, type) lists of classes that the name may use; a class is a struct of its members.
    """
    kind = type_name(name) if isinstance(name, str) else name
    of = lambda i: spark_type(kind.arguments[i], classes)
    if kind.name == "bitset":
        return T.ArrayType(T.BooleanType(), False)
    if kind.name in SEQUENCES:
        return T.ArrayType(of(0), False)
    if kind.name in MAPS or kind.name == "pair":
        pair = T.StructType([T.StructField("first", of(0)), T.StructField("second", of(1))])
        return pair if kind.name == "pair" else T.ArrayType(pair, False)
    if kind.name in SCALARS and not kind.arguments:
        return SCALARS[kind.name]
    if str(kind) in (classes or {}):
        return class_type(str(kind), classes)
    raise KeyError(str(name))


def class_type(name: str, classes: dict[str, list[tuple[str, str]]]) -> T.StructType:
    """A struct from a class description: its members in order, ``x[3]`` an array, base classes' members in their place.

    A member whose name is its type's is a base class.  A class that holds itself has no such type.
    """
    out, rest = T.StructType(), {k: v for k, v in classes.items() if k != name}
    for member, kind in classes[name]:
        if member == kind and kind in classes:
            for f in class_type(kind, rest).fields:
                out.add(f)
            continue
        plain, dims = member.split("[", 1)[0], member.count("[")
        inner = spark_type(kind, rest)
        for _ in range(dims):
            inner = T.ArrayType(inner, False)
        out.add(T.StructField(plain, inner))
    return out
