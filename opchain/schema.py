"""Table layouts.  Complex numbers are structs of two doubles; operators of a term are ordered by site, then id."""

from __future__ import annotations

QN = "array<struct<name:string,val:int,mod:int>>"
COMPLEX = "struct<re:double,im:double>"
OPS = "array<struct<n:int,id:int>>"

OP_CACHE = f"n int, op_id int, name string, dim int, m_re array<double>, m_im array<double>, is_fermionic boolean, qn {QN}"
SITES = f"n int, site_type string, dim int, states array<struct<qn:{QN},dim:int>>"
RAW_TERMS = f"term_id bigint, coeff {COMPLEX}, ops array<struct<name:string,n:int>>"
TERMS = f"term_id bigint, coeff {COMPLEX}, ops {OPS}"
UNIQUE_TERMS = f"ops {OPS}, re double, im double"
EDGES = f"link int, op_id int, jw boolean, suffix {OPS}, re double, im double"
PLACED = "site int, component bigint, right_link int, left_link int, op_id int, jw boolean, re double, im double"
ENTRIES = "site int, component bigint, right_link int, left_link int, i int, j int, re double, im double"
LINKS = f"l int, sector int, qn {QN}, dim int, offset int"
