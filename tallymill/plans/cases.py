"""Programs of every family of operations with the verdict that each must get, written by hand from the rules."""

from __future__ import annotations


def function(params: str, body: str) -> str:
    return f"func.func @f({params}) {{\n {body}\n return }}"


#: Family, program, and the kinds of violations in order.
SCOPES: list[tuple[str, str, str]] = [
    ("return", "func.func @f(%a : i32) -> i32 {\n return %a : i32 }", ""),
    ("return", "func.func @f(%a : i32) -> i32 {\n return %b : i32 }", "undef_use"),
    ("return", "func.func @f(%a : f32) -> i32 {\n return %a : i32 }", "type_mismatch"),
    ("constant", "func.func @f() -> i32 {\n %c = arith.constant 4 : i32\n return %c : i32 }", ""),
    ("constant", "func.func @f() -> i64 {\n %c = arith.constant 4 : i32\n return %c : i64 }", "type_mismatch"),
    ("integer", function("%a : i32, %b : i32", "%0 = arith.muli %a, %b : i32"), ""),
    ("integer", function("%a : i32, %b : i64", "%0 = arith.muli %a, %b : i32"), "type_mismatch"),
    ("integer", function("%a : i32", "%0 = arith.subi %y, %z : i32"), "undef_use,undef_use"),
    ("float", function("%a : f32, %b : f32", "%0 = arith.mulf %a, %b : f32"), ""),
    ("float", function("%a : i32, %b : f32", "%0 = arith.addf %a, %b : f32"), "type_mismatch"),
    ("compare", "func.func @f(%a : i32, %b : i32) -> i1 {\n %c = arith.cmpi slt, %a, %b : i32\n return %c : i1 }", ""),
    ("compare", "func.func @f(%a : i32, %b : i32) -> i32 {\n %c = arith.cmpi slt, %a, %b : i32\n return %c : i32 }", "type_mismatch"),
    ("select", function("%c : i1, %a : i32, %b : i32", "%d = arith.select %c, %a, %b : i32"), ""),
    ("select", function("%c : i32, %a : i32, %b : i32", "%d = arith.select %c, %a, %b : i32"), "type_mismatch"),
    ("cast", "func.func @f(%a : i32) -> i64 {\n %0 = arith.extsi %a : i32 to i64\n return %0 : i64 }", ""),
    ("cast", "func.func @f(%a : i64) -> i64 {\n %0 = arith.extsi %a : i32 to i64\n return %0 : i64 }", "type_mismatch"),
    ("alloc", function("%v : f32, %i : index", "%m = memref.alloc() : memref<4xf32>\n memref.store %v, %m[%i] : memref<4xf32>"), ""),
    ("alloc", function("%v : f32, %i : index", "%m = memref.alloc() : memref<8xf32>\n memref.store %v, %m[%i] : memref<4xf32>"), "type_mismatch"),
    ("load", "func.func @f(%m : memref<?xf32>, %i : index) -> f32 {\n %0 = memref.load %m[%i] : memref<?xf32>\n return %0 : f32 }", ""),
    ("load", "func.func @f(%m : memref<?xf32>, %i : i32) -> f32 {\n %0 = memref.load %m[%i] : memref<?xf32>\n return %0 : f32 }", "type_mismatch"),
    ("store", function("%v : f32, %m : memref<4xf32>, %i : index", "memref.store %v, %m[%i] : memref<4xf32>"), ""),
    ("store", function("%v : i32, %m : memref<4xf32>, %i : index", "memref.store %v, %m[%i] : memref<4xf32>"), "type_mismatch"),
    ("dealloc", function("%m : memref<4xf32>", "memref.dealloc %m : memref<4xf32>"), ""),
    ("dealloc", function("%m : memref<8xf32>", "memref.dealloc %m : memref<4xf32>"), "type_mismatch"),
    ("dim", "func.func @f(%m : memref<?xf32>, %i : index) -> index {\n %0 = memref.dim %m, %i : memref<?xf32>\n return %0 : index }", ""),
    ("dim", "func.func @f(%m : memref<?xf32>, %i : i32) -> index {\n %0 = memref.dim %m, %i : memref<?xf32>\n return %0 : index }", "type_mismatch"),
    ("structured", function("%v : f32, %m : memref<4xf32>", "linalg.fill ins(%v : f32) outs(%m : memref<4xf32>)"), ""),
    ("structured", function("%v : i32, %m : memref<4xf32>", "linalg.fill ins(%v : i32) outs(%m : memref<4xf32>)"), "type_mismatch"),
    ("structured", function("%a : memref<2x3xf32>, %c : memref<2x4xf32>", "linalg.matmul ins(%a, %b : memref<2x3xf32>, memref<3x4xf32>) outs(%c : memref<2x4xf32>)"), "undef_use"),
    ("elementwise", function("%a : tensor<2xf32>", "%0 = stablehlo.add %a,\n  %a : tensor<2xf32>"), ""),
    ("elementwise", function("%a : tensor<2xf32>, %b : tensor<3xf32>", "%0 = stablehlo.add %a, %b : tensor<2xf32>"), "type_mismatch"),
    ("convert", "func.func @f(%a : tensor<2xf32>) -> tensor<2xf16> {\n %0 = stablehlo.convert %a : (tensor<2xf32>) -> tensor<2xf16>\n return %0 : tensor<2xf16> }", ""),
    ("convert", "func.func @f(%a : tensor<2xf64>) -> tensor<2xf16> {\n %0 = stablehlo.convert %a : (tensor<2xf32>) -> tensor<2xf16>\n return %0 : tensor<2xf16> }", "type_mismatch"),
    ("product", function("%a : tensor<2x3xf32>, %b : tensor<3x4xf32>", "%0 = stablehlo.dot_general %a, %b, contracting_dims = [1] x [0] : (tensor<2x3xf32>, tensor<3x4xf32>) -> tensor<2x4xf32>"), ""),
    ("product", function("%a : tensor<2x3xf32>, %b : tensor<9x4xf32>", "%0 = stablehlo.dot_general %a, %b, contracting_dims = [1] x [0] : (tensor<2x3xf32>, tensor<3x4xf32>) -> tensor<2x4xf32>"), "type_mismatch"),
    ("unknown", function("%a : i32", "%0 = some.thing %a, %a : f32"), ""),
    ("scope", "func.func @f(%a : i32) {\n return }\nfunc.func @g() {\n return %a : i32 }", "undef_use"),
    ("scope", "no function at all", ""),
    ("scope", "func.func @f(%a : i32) {\n return %q : i32", ""),
]
