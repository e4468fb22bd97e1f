"""Text and signature functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The diagnostic patterns by category, most telling first, then other patterns and words.
ERROR_PATTERNS = {
    "type_ssa": r"use of value .*? expects different type than prior uses|SSA value .*? has different type|"
    r"block argument .*? has different type|prior use here",
    "type": r"type mismatch|expected .*? but got|incompatible (?:operand|result) types|mismatched operand types|"
    r"op requires all (?:operands|results) to have the same type|op requires the same (?:element )?type|"
    r"operand type .*? does not match|result #\d+ type .*? does not match|failed to verify that .*?(?:types? match|same type)",
    "arity": r"expected \d+ (?:operand|result|argument)s?|op has \d+ operands? but expected|too few operands|too many operands|"
    r"incorrect number of (?:operand|result|argument)s?|number of (?:operand|result|argument)s? does not match",
    "dialect_misuse": r"unregistered operation|unknown operation|operation .*? not (?:registered|defined) in dialect|"
    r"use of unregistered dialect|operation has no verifier",
    "syntax": r"expected '[^']+'|custom op .*? parsing failed|error: expected|parse error|expected (?:SSA|attribute|type|operation)",
}
FAMILIES = ("ew_bin", "ew_un", "dot_general", "broadcast", "transpose", "reshape", "slice")
INT_TYPES = ("i1", "i8", "i16", "i32", "i64")
FLOAT_TYPES = ("f16", "f32", "f64")
PRINTABLE = ("f32", "f64", "i32", "i64")
HINT_DIRECTORIES = ("arith", "func", "linalg", "memref", "scf", "affine")
CHECK_LINE = r"//\s*(?:CHECK|CHECK-LABEL|CHECK-NEXT|CHECK-SAME)[-:]([^\n]*)"
CASE_LINE = r"(?m)^\s*//\s*-----\s*$"
NAMESPACE = r"([a-z_][a-z_0-9]*)\.[a-z_]"
FUNCTION = r"func\.func\s+(?!private\b)@(\w+)\s*\(([^)]*)\)\s*(?:->\s*([^\{]+?))?\s*\{"
MEMREF = r"^memref<((?:(?:\d+|\?)x)+)([fi]\d+)>$"
TENSOR = r"^tensor<((?:(?:\d+|\?)x)*)([a-z]+\d+)>$"
FENCE = r"(?s)```(?:mlir|llvm|c)?\n?(.*?)(?:```|$(?!\n))"
NUMBER = r"(-?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|nan|inf))"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ABSOLUTE, RELATIVE = 1e-5, 1e-4


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalise(c: Column) -> Column:
    """Lower case, without ASCII punctuation, white space collapsed."""
    return collapse(F.translate(F.lower(c), PUNCTUATION, ""))


def or_blank(*cs: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs), F.lit(""))


def truthy(c: Column) -> Column:
    """0 or 1; null is 0."""
    return F.coalesce(c, F.lit(False)).cast("int")


def error_category(stderr: Column) -> Column:
    """Category of a diagnostic, ``other`` if blank or unknown; the patterns' order is their priority."""
    out = F.when(F.trim(F.coalesce(stderr, F.lit(""))) == "", "other")
    for name, pattern in ERROR_PATTERNS.items():
        out = out.when(stderr.rlike("(?iu)" + pattern.replace(".*?", r"[^\n]*?")), name)
    return out.otherwise("other")


def row_category(passed: Column, stderr: Column) -> Column:
    return F.when(F.coalesce(passed, F.lit(False)), "passed").otherwise(error_category(stderr))


def family(name: Column) -> Column:
    """Operator family by the first name that a file name holds."""
    out = F.when(F.lower(name).contains(FAMILIES[0]), FAMILIES[0])
    for f in FAMILIES[1:]:
        out = out.when(F.lower(name).contains(f), f)
    return out.otherwise("other")


def _lines(c: Column) -> Column:
    return F.split(c, r"\r\n|\n|\r", -1)


def without_directives(c: Column) -> Column:
    """Text without RUN, CHECK and splitter lines, one line feed at the end."""
    kept = F.filter(_lines(c), lambda x: ~x.rlike(r"//\s*RUN:") & ~F.trim(x).rlike("^" + CHECK_LINE) & (F.regexp_replace(x, r"^\s+|\s+$", "") != "// -----"))
    return F.concat(F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", ""), F.lit("\n"))


def cases(c: Column) -> Column:
    """Test cases of a file, cleaned, blank ones dropped."""
    return F.filter(F.transform(F.split(c, CASE_LINE, -1), without_directives), lambda x: F.trim(F.translate(x, "\n\t\r", "")) != "")


def check_hints(c: Column) -> Column:
    """What CHECK lines say, in order."""
    hits = F.filter(F.transform(_lines(c), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x.rlike("^" + CHECK_LINE))
    return F.transform(hits, lambda x: F.trim(F.regexp_extract(x, "^" + CHECK_LINE, 1)))


def namespaces(c: Column) -> Column:
    """Sorted distinct namespaces that a text mentions."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(NAMESPACE), F.lit(1))))


def path_description(path: Column) -> Column:
    """Hint directories of a path, then its stem as words."""
    parts = F.filter(F.split(F.lower(path), "/"), lambda x: x != "")
    hints = F.filter(parts, lambda x: x.isin(*HINT_DIRECTORIES))
    stem = F.translate(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(.)\.[^.]*$", "$1"), "_-", "  ")
    return F.array_join(F.concat(hints, F.array(stem)), " ")


def fence_body(c: Column) -> Column:
    """The first code fence's body, else the text from ``module {`` on, else the text."""
    at = F.instr(c, "module {")
    return F.when(c.contains("```"), F.regexp_replace(F.regexp_extract(c, FENCE, 1), r"^\s+|\s+$", "")).when(at > 0, F.substring(c, at, F.length(c))).otherwise(c)


def ssa_refs(c: Column) -> Column:
    """Distinct ``%name`` references in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"%([A-Za-z0-9_]+)"), F.lit(1)))


def signature(c: Column) -> Column:
    """(name, arg_types, ret) of the first function that is not private, else null.

    An argument without a type makes the whole signature null.
    """
    part = lambda k: F.regexp_extract(c, FUNCTION, k)
    pieces = F.when(F.trim(part(2)) == "", F.expr("cast(array() AS array<string>)")).otherwise(F.split(part(2), ","))
    types = F.transform(pieces, lambda x: F.regexp_replace(F.element_at(F.split(x, ":"), -1), r"\s", ""))
    typed = ~F.exists(pieces, lambda x: ~x.contains(":"))
    return F.when(c.rlike(FUNCTION) & typed, F.struct(part(1).alias("name"), types.alias("arg_types"), F.regexp_replace(part(3), r"\s", "").alias("ret")))


def _shaped(t: Column, pattern: str) -> Column:
    dims = F.filter(F.split(F.regexp_extract(t, pattern, 1), "x"), lambda x: x != "")
    return F.when(t.rlike(pattern), F.struct(dims.alias("dims"), F.regexp_extract(t, pattern, 2).alias("dtype")))


def memref(t: Column) -> Column:
    """(dims, dtype) of a ranked memref type, else null (of rank 0, too)."""
    return _shaped(t, MEMREF)


def tensor(t: Column) -> Column:
    """(dims, dtype) of a tensor type, else null; rank 0 has no dims."""
    return _shaped(t, TENSOR)


def _fits(gold: Column, candidate: Column, shaped) -> Column:
    """Same rank and element type, and each candidate dim is ? or the gold one."""
    a, b = shaped(gold), shaped(candidate)
    dims = F.forall(F.zip_with(a["dims"], b["dims"], lambda x, y: (y == "?") | x.eqNullSafe(y)), lambda x: F.coalesce(x, F.lit(False)))
    return F.coalesce((a["dtype"] == b["dtype"]) & (F.size(a["dims"]) == F.size(b["dims"])) & dims, F.lit(False))


def compatible(gold: Column, candidate: Column, shaped=memref, relax_result: bool = False) -> Column:
    """(compatible, relaxed) of two signatures: types are equal, or shaped ones that fit.

    Results have to be equal unless ``relax_result``, as tensor signatures have it.
    """
    alike = lambda g, c: g.eqNullSafe(c) | _fits(g, c, shaped)
    pairs = F.zip_with(gold["arg_types"], candidate["arg_types"], lambda g, c: F.struct(g.alias("g"), c.alias("c")))
    result = alike(gold["ret"], candidate["ret"]) if relax_result else gold["ret"] == candidate["ret"]
    ok = result & (F.size(gold["arg_types"]) == F.size(candidate["arg_types"])) & F.forall(pairs, lambda p: alike(p["g"], p["c"]))
    ok = F.coalesce(ok, F.lit(False))
    differ = F.exists(pairs, lambda p: ~p["g"].eqNullSafe(p["c"])) | ~gold["ret"].eqNullSafe(candidate["ret"])
    return F.struct(ok.alias("compatible"), (ok & differ).alias("relaxed"))


def exclusion(sig: Column) -> Column:
    """Why a signature can't be driven, the first reason that holds; null if it can."""
    plain = [*INT_TYPES, *FLOAT_TYPES, "index"]
    args = F.coalesce(sig["arg_types"], F.expr("cast(array() AS array<string>)"))

    def reason(t: Column) -> Column:
        m = memref(t)
        return (
            F.when(t.startswith("memref") & m.isNull(), "unsupported_memref_type")
            .when(t.startswith("memref") & ~m["dtype"].isin(*PRINTABLE), "unprintable_memref_dtype")
            .when(~t.startswith("memref") & ~t.isin(*plain), "unsupported_arg_type")
        )

    first = F.element_at(F.filter(F.transform(args, reason), lambda x: x.isNotNull()), 1)
    return (
        F.when(sig.isNull(), "no_public_fn")
        .when(sig["name"] == "main", "fn_named_main")
        .when(sig["ret"].startswith("(") | sig["ret"].contains(","), "multi_result")
        .when((sig["ret"] != "") & ~sig["ret"].isin(*plain), "unsupported_ret_type")
        .when(F.exists(F.transform(args, reason), lambda x: x.isNotNull()), first)
        .when((sig["ret"] == "") & ~F.exists(args, lambda t: t.startswith("memref")), "no_observable_output")
    )


def near(a: Column, b: Column, exact: bool = False, strict: bool = False) -> Column:
    """Tolerant equality of doubles: NaN equals NaN alone.  An infinity is near any finite number and
    not near itself, as the tolerance has it; ``strict`` makes infinities equal only to themselves."""
    if exact:
        close = a == b
    else:
        close = F.abs(a - b) <= F.lit(ABSOLUTE) + F.lit(RELATIVE) * F.greatest(F.abs(a), F.abs(b))
        close = close & ~F.isnan(a - b)
        if strict:
            inf = F.lit(float("inf"))
            close = F.when((F.abs(a) == inf) | (F.abs(b) == inf), a == b).otherwise(close)
    return (F.isnan(a) & F.isnan(b)) | (~F.isnan(a) & ~F.isnan(b) & close)


def arrays_near(a: Column, b: Column, exact: bool = False, strict: bool = False) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: near(x, y, exact, strict)), lambda x: F.coalesce(x, F.lit(False)))


def memo_key(text: Column, *flags: Column) -> Column:
    """SHA-256 of the text and its flags, each after a zero byte."""
    return F.sha2(F.concat_ws("\0", text, *flags), 256)


def derived_seed(key: Column, trial: Column, salt: str = "e12c") -> Column:
    """A number from the first 12 hex digits of a digest."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(salt), key, trial.cast("string")), 256), 1, 12), 16, 10).cast("long")


def prefix_index(name: Column) -> Column:
    """``007_name`` is 6; null without a number in front."""
    return F.split(name, "_")[0].try_cast("int") - 1


def backend(model: Column) -> Column:
    """The backend by what the model's name holds."""
    m = F.lower(model)
    return F.when(m.rlike("phi|smollm|gemma"), "mlx").when(m.rlike("codellama|granite"), "ollama").otherwise("mock")


def truncated(c: Column) -> Column:
    """More opening than closing braces."""
    return F.regexp_count(c, F.lit(r"\{")) > F.regexp_count(c, F.lit(r"\}"))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))


def eligible(c: Column, allowed: list[str], marker: str, barred: str) -> Column:
    """Namespaces within the allowed ones and not none, with the marker, without the barred string, not blank."""
    found = namespaces(c)
    inside = F.size(F.array_except(found, F.array(*map(F.lit, allowed)))) == 0
    return inside & (F.size(found) > 0) & c.contains(marker) & ~c.contains(barred) & (F.trim(c) != "")


def entropy_bits(p: Column) -> Column:
    """Shannon entropy of an array of probabilities, in bits."""
    return F.aggregate(F.filter(p, lambda x: x > 0), F.lit(0.0), lambda a, x: a - x * F.log2(x))


def numbers(c: Column) -> Column:
    """All numbers of a text, as doubles."""
    found = F.regexp_extract_all(c, F.lit(NUMBER), F.lit(1))
    return F.transform(found, lambda x: F.when(x == "inf", float("inf")).when(x == "-inf", float("-inf")).when(x.contains("nan"), float("nan")).otherwise(x.try_cast("double")))


def matches(output: Column, pattern: Column) -> Column:
    """Whether an expected-output pattern occurs, over lines (``^ $`` at each line, ``.`` any character)."""
    return F.rlike(output, F.concat(F.lit("(?ms)"), pattern))


def pretty_signature(args: Column) -> Column:
    """``type:$name`` of each argument, separated by commas."""
    return F.array_join(F.transform(args, lambda a: F.concat(a["type_constraint"], F.lit(":$"), a["name"])), ", ")


def guarded(program: Column, returncode: Column, stderr: Column) -> Column:
    """A verifier's verdict, or -3 for a program without a function: compilers accept empty text as a valid module."""
    some = F.coalesce(F.contains(program, F.lit("func.func @")), F.lit(False))
    reason = F.lit("phase-F non-triviality check: no func.func definition in input")
    return F.when(some, F.struct(returncode.cast("int").alias("returncode"), stderr.alias("stderr"))).otherwise(F.struct(F.lit(-3).alias("returncode"), reason.alias("stderr")))
