"""Acceptance by the small generation grammar, as one regular expression that Spark evaluates itself.

The grammar nests only in memref element types, which the pattern follows to a fixed depth.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of the grammar.
INT_BINARY = "addi subi muli divsi divui andi ori xori shli shrsi shrui maxsi maxui minsi minui remsi remui".split()
FLOAT_BINARY = "addf subf mulf divf remf".split()
INT_COMPARE = "eq ne slt sle sgt sge ult ule ugt uge".split()
FLOAT_COMPARE = "oeq one olt ole ogt oge ueq une ult ule ugt uge ord uno false true".split()
DEPTH = 4


def _any(words) -> str:
    return f"(?:{'|'.join(words)})"


def pattern(most_ops: int = 6) -> str:
    """A regular expression for whole modules of the grammar, of up to ``most_ops`` operations."""
    ws, o = r"[ \t\n]{1,8}", r"(?:[ \t\n]{1,8})?"
    ssa, sym, integer = r"%[a-zA-Z0-9_]{1,32}", r"@[a-zA-Z_][a-zA-Z0-9_]{0,47}", r"-?[0-9]+"
    real = rf"{integer}\.[0-9]+(?:e[+-]?[0-9]+)?"
    ints, floats, index = r"i(?:16|1|8|32|64)", r"(?:bf16|f16|f32|f64)", "index"
    whole = f"(?:{ints}|{index})"
    types = f"(?:{ints}|{floats}|{index})"
    memref = f"memref<(?:(?:[0-9]+|\\?)x)*{types}>"
    for _ in range(DEPTH):
        memref = f"memref<(?:(?:[0-9]+|\\?)x)*(?:{types}|{memref})>"
    any_type = f"(?:{types}|{memref})"
    of = lambda t: f"{ws}:{ws}{t}"
    comma, to = f"{ws},{ws}", f"{ws}to{ws}"
    define = f"{ssa}{ws}={ws}"
    two = f"{ssa}{comma}{ssa}"
    indices = rf"\[(?:{ssa}(?:{comma}{ssa})*)?\]"
    ins = lambda body: f"ins{o}\\({o}{body}{o}\\)"
    ins1, ins2 = ins(f"{ssa}{o}:{ws}{memref}"), ins(f"{ssa}{o},{o}{ssa}{o}:{ws}{memref}{o},{ws}{memref}")
    fill, outs = ins(f"{ssa}{o}:{ws}{types}"), f"outs{o}\\({o}{ssa}{o}:{ws}{memref}{o}\\)"
    dims = rf"\[{o}(?:{integer}(?:{o},{o}{integer})*{o})?\]"
    arith = lambda words: r"arith\." + _any(words)
    op = _any(
        [
            rf"{define}arith\.constant{ws}(?:{real}{of(floats)}|{integer}{of(whole)})",
            f"{define}{arith(INT_BINARY)}{ws}{two}{of(whole)}",
            f"{define}{arith(FLOAT_BINARY)}{ws}{two}{of(floats)}",
            rf"{define}arith\.cmpi{ws}{_any(INT_COMPARE)}{comma}{two}{of(whole)}",
            rf"{define}arith\.cmpf{ws}{_any(FLOAT_COMPARE)}{comma}{two}{of(floats)}",
            rf"{define}arith\.select{ws}{ssa}{comma}{two}{of(f'(?:{whole}|{floats})')}",
            f"{define}{arith(['extsi', 'extui', 'trunci'])}{ws}{ssa}{of(ints)}{to}{ints}",
            f"{define}{arith(['sitofp', 'uitofp'])}{ws}{ssa}{of(whole)}{to}{floats}",
            f"{define}{arith(['fptosi', 'fptoui'])}{ws}{ssa}{of(floats)}{to}{whole}",
            f"{define}{arith(['extf', 'truncf'])}{ws}{ssa}{of(floats)}{to}{floats}",
            f"{define}{arith(['index_castui', 'index_cast'])}{ws}{ssa}{of(whole)}{to}{whole}",
            rf"{define}arith\.bitcast{ws}{ssa}{of(any_type)}{to}{any_type}",
            rf"{define}memref\.alloc\(\){of(memref)}",
            rf"{define}memref\.load{ws}{ssa}{indices}{of(memref)}",
            rf"memref\.store{ws}{ssa}{comma}{ssa}{indices}{of(memref)}",
            rf"memref\.dealloc{ws}{ssa}{of(memref)}",
            rf"{define}memref\.dim{ws}{two}{of(memref)}",
            rf"linalg\.(?:matmul|matvec|add|sub|mul|div){ws}{ins2}{ws}{outs}",
            rf"linalg\.fill{ws}{fill}{ws}{outs}",
            rf"linalg\.copy{ws}{ins1}{ws}{outs}",
            rf"linalg\.transpose{ws}{ins1}{ws}{outs}{ws}permutation{ws}={ws}{dims}",
            rf"linalg\.broadcast{ws}{ins1}{ws}{outs}{ws}dimensions{ws}={ws}{dims}",
            rf"linalg\.(?:exp|abs){ws}(?:{ins1}|{ins2}){ws}{outs}",
            f"return{ws}{ssa}{of(any_type)}",
            "return",
        ]
    )
    param = f"{ssa}{of(any_type)}"
    result = rf"{ws}->{ws}(?:{any_type}|\({any_type}(?:{comma}{any_type})*\))"
    function = rf"func\.func{ws}{sym}\((?:{param}(?:{comma}{param})*)?\)(?:{result})?{ws}\{{{ws}{op}(?:{ws}{op}){{0,{most_ops - 1}}}{ws}\}}"
    return rf"\Amodule{ws}\{{{ws}{function}{ws}\}}{o}\z"


def accepts(c: Column, most_ops: int = 6) -> Column:
    """Whether a text is a module of the grammar; null is not."""
    return F.coalesce(c.rlike(pattern(most_ops)), F.lit(False))
