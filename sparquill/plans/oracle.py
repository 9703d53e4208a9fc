"""The same results as ANSI SQL for DuckDB, with constants as literals. Written apart from the expressions they check."""

from __future__ import annotations

from ..specs import STORED_BITS, MseSpec, ProdSpec, ValueSpec, packed_bytes


def vec(values) -> str:
    return "[" + ",".join(f"{float(v)!r}::double" if i == 0 else repr(float(v)) for i, v in enumerate(values)) + "]"


def mat(rows) -> str:
    return "[" + ",".join(vec(r) for r in rows) + "]"


def _apply(matrix: str, vector: str) -> str:
    return f"list_transform({matrix}, lambda mr: list_inner_product(mr, {vector}))"


def mse_state(spec: MseSpec, name: str = "st") -> str:
    book = spec.codebook
    return f"{name} as (select {mat(spec.pi)} as pi, {mat(spec.pi.T)} as pit, {vec(book.boundaries)} as bd, {vec(book.centroids)} as ce)"


def _stored(*names: str) -> str:
    """Numbers as a code stores them, in single precision."""
    return ", ".join(f"{n}::float::double as {n}" for n in names)


def mse_quantize(source: str, out: str, state: str = "st", x: str = "x", stored: bool = True) -> str:
    """CTEs that add xd, norm and idx to source; the norm as the code stores it, or as it is worked with."""
    norm = _stored("norm") if stored else "norm"
    return f"""{out}_1 as (select *, list_transform({x}, lambda v: v::double) as xd from {source}),
{out}_2 as (select *, sqrt(list_inner_product(xd, xd)) as norm from {out}_1),
{out}_3 as (select *, list_transform(xd, lambda v: v * (1 / (norm + 1e-10))) as u from {out}_2),
{out}_4 as (select {out}_3.*, {_apply("pi", "u")} as y from {out}_3, {state}),
{out} as (select {out}_4.* exclude (u, y, norm), {norm}, list_transform(y, lambda v: len(list_filter(bd, lambda b: b < v))) as idx from {out}_4, {state})"""


def mse_dequantize(source: str, out: str, state: str = "st", to: str = "xhat") -> str:
    return f"""{out}_1 as (select {source}.*, list_transform(idx, lambda i: ce[i + 1]) as c from {source}, {state}),
{out}_2 as (select {out}_1.*, {_apply("pit", "c")} as b from {out}_1, {state}),
{out} as (select * exclude (c, b), list_transform(b, lambda v: v * norm) as {to} from {out}_2)"""


def prod_state(spec: ProdSpec) -> str:
    return mse_state(spec.mse) + f",\nsk as (select {mat(spec.s)} as s, {mat(spec.s.T)} as str)"


def prod_quantize(source: str, out: str, x: str = "x") -> str:
    return f"""{mse_quantize(source, out + "_a", x=x, stored=False)},
{mse_dequantize(out + "_a", out + "_b", to="xm")},
{out}_c as (select *, list_transform(range(1, len(xd) + 1), lambda i: xd[i] - xm[i]) as r from {out}_b),
{out}_d as (select {out}_c.*, sqrt(list_inner_product(r, r)) as residual_norm, {_apply("s", "r")} as p from {out}_c, sk),
{out} as (select * exclude (r, p, xm, norm, residual_norm), {_stored("norm", "residual_norm")}, list_transform(p, lambda v: case when v > 0 then 1 else 0 end) as sign from {out}_d)"""


def prod_dequantize(source: str, out: str, spec: ProdSpec, to: str = "xhat") -> str:
    return f"""{mse_dequantize(source, out + "_a", to="xm")},
{out}_b as (select *, list_transform(sign, lambda b: (2 * b - 1)::double) as pm from {out}_a),
{out}_c as (select {out}_b.*, {_apply("str", "pm")} as w from {out}_b, sk),
{out} as (select * exclude (pm, w, xm), list_transform(range(1, len(xm) + 1), lambda i: xm[i] + {spec.scale!r} * residual_norm * w[i]) as {to} from {out}_c)"""


def value_quantize(source: str, out: str, spec: ValueSpec, v: str = "v") -> str:
    g = spec.group_size
    return f"""{out}_1 as (select *, list_transform(range(0, {spec.dim // g}), lambda k: list_transform({v}[k * {g} + 1:(k + 1) * {g}], lambda a: a::double)) as g from {source}),
{out}_2 as (select *, list_transform(g, lambda a: list_min(a)) as zeros, list_transform(g, lambda a: greatest((list_max(a) - list_min(a)) * {1.0 / spec.levels!r}, 1e-10)) as scales from {out}_1),
{out} as (select * exclude (g, zeros, scales), {", ".join(f"list_transform({c}, lambda v: v::float::double) as {c}" for c in ("zeros", "scales"))}, flatten(list_transform(range(1, len(g) + 1), lambda k: list_transform(g[k], lambda a: least(greatest(round_even((a - zeros[k]) * (1 / scales[k]), 0), 0), {spec.levels})::int))) as vidx from {out}_2)"""


def value_dequantize(source: str, out: str, spec: ValueSpec, to: str = "vhat") -> str:
    g = spec.group_size
    return f"{out} as (select *, list_transform(range(1, len(vidx) + 1), lambda i: vidx[i] * scales[(i - 1) // {g} + 1] + zeros[(i - 1) // {g} + 1]) as {to} from {source})"


def hex_text(indices: str, dim: int, bits: int) -> str:
    width = STORED_BITS[bits]
    per = 8 // width
    byte = " + ".join(f"coalesce({indices}[b * {per} + {k + 1}], 0) * {1 << (width * k)}" for k in range(per))
    return f"array_to_string(list_transform(range(0, {packed_bytes(dim, bits)}), lambda b: printf('%02X', ({byte})::int)), '')"


def squared_error(a: str, b: str) -> str:
    """b is a decoded vector, in single precision."""
    b = f"list_transform({b}, lambda v: v::float::double)"
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
