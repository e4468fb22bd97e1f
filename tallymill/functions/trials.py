"""Trial inputs of differential evaluation, and comparison of the printed outputs."""

from __future__ import annotations

import hashlib
import random
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymill.functions.programs import balanced
from tallymill.functions.text import FLOAT_TYPES, NUMBER, arrays_near

OUTPUT = "scalars array<double>, memrefs array<struct<sizes:array<int>,data:array<double>>>"
_number = re.compile(NUMBER)


def trial_inputs(arg_types: list[str], key: str, trial: int, salt: str = "e12c") -> list[list[float]]:
    """Values of each argument, the same for everyone who asks with this key and trial.

    Open dims are 3 + trial.  Floats are quarters from 0.5 to 8, buffers of integers hold 1 to 7, scalar
    integers stay below the smallest dim (without buffers: 1 to 7), so that they index and divide safely.
    """
    rng = random.Random(int(hashlib.sha256(f"{salt}:{key}:{trial}".encode()).hexdigest()[:12], 16))
    shapes = [[3 + trial if d == "?" else int(d) for d in m[1].split("x")[:-1]] if (m := re.match(r"memref<((?:(?:\d+|\?)x)+)[fi]\d+>$", t)) else None for t in arg_types]
    dims = [d for s in shapes if s for d in s]
    out = []
    for t, shape in zip(arg_types, shapes):
        size = 1
        for d in shape or ():
            size *= d
        real = t in FLOAT_TYPES or shape is not None and t.rstrip(">").rsplit("x", 1)[-1].startswith("f")
        if real:
            out.append([rng.randrange(2, 33) * 0.25 for _ in range(size)])
        elif shape is not None:
            out.append([float(rng.randint(1, 7)) for _ in range(size)])
        elif t == "i1":
            out.append([float(rng.randint(0, 1))])
        else:
            out.append([float(rng.randint(0, min(dims) - 1) if dims else rng.randint(1, 7))])
    return out


def outputs(text: str) -> dict:
    """Printed scalars, then buffers with their sizes and data; data is the balanced block after ``data =``."""
    head, *blocks = text.split("Unranked Memref")
    found = []
    for block in blocks:
        sizes = re.search(r"sizes = \[([^\]]*)\]", block)
        at = block.find("data =")
        begin = block.find("[", at) if at >= 0 else -1
        end = balanced(block, begin, "[]") if begin >= 0 else -1
        data = block[begin : end + 1 if end >= 0 else None] if begin >= 0 else block[at + 6 :] if at >= 0 else ""
        found.append({"sizes": [int(x) for x in sizes[1].split(",") if x.strip()] if sizes else [], "data": [float(x) for x in _number.findall(data)]})
    return {"scalars": [float(x) for x in _number.findall(head)], "memrefs": found}


def parsed_outputs(c: Column) -> Column:
    """:func:`outputs` as a column; numbers travel as text, as pandas would turn NaN into null."""
    written = lambda x: {"scalars": [repr(v) for v in x["scalars"]], "memrefs": [m | {"data": [repr(v) for v in m["data"]]} for m in x["memrefs"]]}

    @F.pandas_udf(OUTPUT.replace("double", "string"))
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([written(outputs(x)) if x is not None else {"scalars": None, "memrefs": None} for x in s], columns=["scalars", "memrefs"])

    return run(c).cast(f"struct<{OUTPUT.replace(' array', ':array')}>")


def inputs_of(arg_types: Column, key: Column, trial: Column) -> Column:
    @F.pandas_udf("array<array<double>>")
    def run(a: pd.Series, k: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([trial_inputs(list(x), y, int(z)) if x is not None else None for x, y, z in zip(a, k, t)])

    return run(arg_types, key, trial)


def outputs_equal(a: Column, b: Column, exact: bool = False, strict: bool = False) -> Column:
    """Whether two parsed outputs hold the same scalars and buffers, within the tolerance."""
    same = lambda x, y: F.coalesce((x["sizes"] == y["sizes"]) & arrays_near(x["data"], y["data"], exact, strict), F.lit(False))
    buffers = (F.size(a["memrefs"]) == F.size(b["memrefs"])) & F.forall(F.zip_with(a["memrefs"], b["memrefs"], same), lambda x: x)
    return F.coalesce(arrays_near(a["scalars"], b["scalars"], exact, strict) & buffers, F.lit(False))
