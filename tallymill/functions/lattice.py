"""Operator type lattices: closed vocabularies of constraint classes, entries, and post-hoc checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY, UNBOUNDED = "ANY", 10**6
# What each constraint class allows.
INTS = ["i1", "i8", "i16", "i32", "i64", "i128"]
FLOATS = ["f16", "bf16", "f32", "f64"]
PRIMITIVES = [*INTS, *FLOATS, "index"]
CLASSES: dict[str, list[str]] = {
    "AnyInteger": INTS,
    "AnySignlessInteger": INTS,
    "SignlessInteger": INTS,
    "SignlessFixedWidthIntegerLike": INTS,
    "AnyNonZeroBitwidthSignlessIntegerOrIndex": [*INTS, "index"],
    "IndexOrSignlessInteger": [*INTS, "index"],
    "SignlessIntegerLike": [*INTS, "index"],
    "IntegerLike": [*INTS, "index"],
    "SignlessIntegerOrIndexLike": [*INTS, "index"],
    "Arith_SignlessIntegerOrIndexLike": [*INTS, "index"],
    "I1": ["i1"],
    "I8": ["i8"],
    "I16": ["i16"],
    "I32": ["i32"],
    "I64": ["i64"],
    "I128": ["i128"],
    "F16": ["f16"],
    "BF16": ["bf16"],
    "F32": ["f32"],
    "F64": ["f64"],
    "Index": ["index"],
    "AnyFloat": FLOATS,
    "FloatLike": FLOATS,
    "AnyType": [ANY],
    "AnyShaped": [ANY],
    "AnyRankedTensor": [ANY],
    "AnyIntegerAttr": [ANY],
    "TypedAttrInterface": [ANY],
    "AnyRankedOrUnrankedMemRef": ["memref"],
    "AnyMemRef": ["memref"],
    "MemRefOf": ["memref"],
    "AnyTensor": ["tensor"],
    "TensorOf": ["tensor"],
    "AnyVector": ["vector"],
    "VectorOf": ["vector"],
    "AnyVectorOfAnyRank": ["vector"],
}


def expanded(constraint: Column) -> Column:
    """Types of a class, of the class outside ``<>``, or ANY."""
    table = F.create_map(*[x for k, v in CLASSES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    name = F.trim(constraint)
    outer = F.regexp_extract(name, r"^(\w+)\s*<.+>\s*$", 1)
    return F.coalesce(table[name], table[outer], F.array(F.lit(ANY)))


def entries(ops: DataFrame) -> DataFrame:
    """Lattice entry of each operator record: types and arities of its slots, attributes, slots of one type."""
    operands = F.filter("arguments", lambda a: ~a["is_attribute"])
    types = lambda slots: F.transform(slots, lambda a: expanded(a["type_constraint"]))
    least = lambda slots: F.size(F.filter(slots, lambda a: ~a["variadic"]))
    most = lambda slots: F.when(F.exists(slots, lambda a: a["variadic"]), UNBOUNDED).otherwise(F.size(slots))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() AS array<int>)"))
    all_slots, args = F.size(operands) + F.size("results"), F.size(operands)
    none = F.expr("cast(array() AS array<array<int>>)")
    same = F.when(F.array_contains("traits", "SameOperandsAndResultType"), F.array(upto(all_slots))).when(F.array_contains("traits", "SameOperandsType"), F.array(upto(args))).otherwise(none)
    return ops.select(
        "full_name", "dialect", types(operands).alias("operand_types"), types(F.col("results")).alias("result_types"),
        F.array(least(operands), most(operands)).alias("operand_arity"), F.array(least(F.col("results")), most(F.col("results"))).alias("result_arity"),
        F.transform(F.filter("arguments", lambda a: a["is_attribute"]), lambda a: a["type_constraint"]).alias("attributes"), same.alias("same_type_classes"),
    )


def admits(text: Column, operand_types: Column, result_types: Column) -> Column:
    """Whether the text after the last colon starts with a type that some slot allows.

    Unknown operators (null types) and ANY admit all; a known one admits no text without a colon.
    """
    allowed = F.flatten(F.concat(operand_types, result_types))
    tail = F.regexp_replace(F.trim(F.substring_index(text, ":", -1)), r"[,;})]+$", "")
    fits = F.exists(allowed, lambda t: (t == ANY) | tail.startswith(t))
    return F.when(operand_types.isNull(), True).when(~text.contains(":"), False).otherwise(fits)


def next_characters(types: Column, prefix: Column) -> Column:
    """Characters that may follow a prefix of the allowed primitive types (all of them for ANY or containers)."""
    known = F.array_intersect(types, F.array(*map(F.lit, PRIMITIVES)))
    free = F.array_contains(types, ANY) | (F.size(known) == 0)
    use = F.when(free, F.array(*map(F.lit, PRIMITIVES))).otherwise(known)
    longer = F.filter(use, lambda t: t.startswith(prefix) & (F.length(t) > F.length(prefix)))
    return F.array_sort(F.array_distinct(F.transform(longer, lambda t: F.substring(t, F.length(prefix) + 1, F.lit(1)))))


def arity_state(count: Column, arity: Column) -> Column:
    """What may come after ``count`` operands: another one, a separator, the end."""
    return F.struct(
        (count < arity[1]).alias("operand"), ((count > 0) & (count < arity[1])).alias("separator"), (count >= arity[0]).alias("end")
    )
