"""Queries over the driver's tables, one for each operator or family of operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opchain.functions import terms as X
from opchain.operators import cover, graph, rewrite, tensor
from opchain.operators import terms as sums
from opchain.plans.arrow import send_package
from opchain.plans.bonds import bond_dimensions as bonds
from opchain.plans.build import Options, build, numbered_through, sectors
from opchain.plans.ranges import running_total
from opchain.plans.scratch import Scratch
from opchain.sources import adapters, generate
from opchain.sources.catalog import Catalog, site_type

N = adapters.N_SITES
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def pauli() -> Catalog:
    return Catalog.uniform("Qubit", N, ["I", "X", "Y", "Z"], conserve=False)


def fermions() -> Catalog:
    return Catalog.uniform("Fermion", N, ["I", "C", "Cdag", "N"])


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = WITH + sql
        return f

    return keep


WITH = """with recursive lines as (select l_orderkey as k, 1 + l_suppkey % 8 as n, 2 + l_partkey % 3 as id, cast(l_quantity as bigint) as q, l_linenumber as ln, l_partkey as p, l_suppkey as s from lineitem),
firsts as (select k, n, (list(id order by ln, p, s, q, id))[1] as id, sum(q) as q from lines group by k, n),
terms as (select k as term_id, cast(sum(q) as double) as w from firsts group by k),
ops as (select k as term_id, n, id from firsts),
keys as (select term_id, string_agg(n || ':' || id, '|' order by n desc) as key from ops group by term_id),
uniq as (select key, sum(w) as w from terms join keys using (term_id) group by key),
uops as (select key, cast(split_part(x, ':', 1) as int) as n, cast(split_part(x, ':', 2) as int) as id from (select key, unnest(string_split(key, '|')) as x from uniq)),
raw as (select k as term_id, row_number() over (partition by k order by ln, p, s, q, n, id) as pos, n, id, q from lines),
pg as (select l_orderkey as lv, l_partkey as rv, sum(cast(case when l_linenumber % 2 = 1 then -l_quantity else l_quantity end as bigint)) as w from lineitem where l_quantity >= 48 group by 1, 2)
"""
#: Labels by repeated minima over the edges, as a table keyed by left vertex.
COMPONENTS = """, label(lv, component) using key (lv) as (select distinct lv, lv from pg union
  select b.lv, min(l.component) from label l join pg a on a.lv = l.lv join pg b on b.rv = a.rv join recurring.label o on o.lv = b.lv where l.component < o.component group by b.lv)
"""


def unique_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sums.combine(sums.append(adapters.order_terms(spark, sf_dir), pauli()))


@query("select term_id, key, w as coeff from terms join keys using (term_id)")
def canonical_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in canonical form."""
    t = sums.append(adapters.order_terms(spark, sf_dir), pauli())
    return t.select("term_id", X.key_text(F.col("ops")).alias("key"), F.col("coeff.re").alias("coeff"))


@query("select key, w as coeff from uniq")
def combined_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like terms added up."""
    return unique_terms(spark, sf_dir).select(X.key_text(F.col("ops")).alias("key"), F.col("re").alias("coeff"))


@query("select term_id, w as coeff from terms where w > 60")
def dropped_small_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms over a tolerance."""
    return sums.append(adapters.order_terms(spark, sf_dir), pauli(), abs_tol=60).select("term_id", F.col("coeff.re").alias("coeff"))


@query("""select t.term_id, case when coalesce(m, 0) % 2 = 1 then -1 else 1 end as sign from (select distinct term_id from raw) t
left join (select a.term_id, count(*) as m from raw a join raw b on a.term_id = b.term_id and a.pos < b.pos and a.n > b.n where a.id in (2, 3) and b.id in (2, 3) group by 1) x on t.term_id = x.term_id""")
def fermion_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sign of putting each order's lines, as fermionic operators, in the order of their sites."""
    return adapters.raw_order_terms(spark, sf_dir).select("term_id", X.fermion_sign(F.col("ops"), fermions()).alias("sign"))


@query("""select t.term_id, s.n, coalesce(o.id, 1) as op_id from terms t cross join (select unnest(range(1, 9)) as n) s left join ops o on o.term_id = t.term_id and o.n = s.n""")
def onsite_op(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each term's operator on each site."""
    t = adapters.order_terms(spark, sf_dir).select("term_id", "ops", F.explode(F.sequence(F.lit(1), F.lit(N))).alias("n"))
    return t.select("term_id", F.col("n").cast("long").alias("n"), X.onsite_op(F.col("ops"), F.col("n")).cast("long").alias("op_id"))


@query("""select t.term_id, s.n, count(o.id) % 2 = 1 as odd from terms t cross join (select unnest(range(1, 9)) as n) s left join ops o on o.term_id = t.term_id and o.n >= s.n and o.id in (2, 3) group by 1, 2""")
def suffix_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fermion parity of each term from each site on."""
    t = adapters.order_terms(spark, sf_dir).select("term_id", "ops", F.explode(F.sequence(F.lit(1), F.lit(N))).alias("n"))
    return t.select("term_id", F.col("n").cast("long").alias("n"), X.is_odd(F.col("ops"), F.col("n"), fermions()).alias("odd"))


@query("""select t.term_id, cast(coalesce(sum(case o.id when 2 then -1 when 3 then 1 else 0 end), 0) as bigint) as nf from terms t left join ops o on o.term_id = t.term_id and o.n >= 3 group by 1""")
def term_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each term's particle number from site 3 on."""
    t = adapters.order_terms(spark, sf_dir)
    return t.select("term_id", X.flux(F.col("ops"), 3, fermions())[0]["val"].cast("long").alias("nf"))


@query("""select a.term_id, b.term_id as other_id, a.s = b.s as equal from (select term_id, coalesce(string_agg(case when n >= 5 then n || ':' || id end, '|' order by n), '') as s from ops group by 1) a
join (select term_id, coalesce(string_agg(case when n >= 5 then n || ':' || id end, '|' order by n), '') as s from ops group by 1) b on b.term_id = a.term_id + 1""")
def terms_equal_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each term and the one with the next id are equal from site 5 on."""
    t = adapters.order_terms(spark, sf_dir).select("term_id", "ops")
    other = t.select((F.col("term_id") - 1).alias("term_id"), F.col("term_id").alias("other_id"), F.col("ops").alias("other"))
    return t.join(other, "term_id").select("term_id", "other_id", X.equal_from(F.col("ops"), F.col("other"), 5).alias("equal"))


@query("select term_id, n, string_agg(id, ',' order by pos) as ids from raw group by 1, 2")
def same_site_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each term's operators on each site, in their order."""
    runs = sums.runs_on_one_site(adapters.raw_order_terms(spark, sf_dir))
    return runs.select("term_id", F.col("n").cast("long").alias("n"), F.array_join("ids", ",").alias("ids"))


@query("""select n, 'op' || id as name, row_number() over (partition by n order by t, pos) + 1 as op_id from (select n, id, min(term_id) as t, arg_min(pos, term_id * 100 + pos) as pos from raw group by 1, 2)""")
def first_appearance_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of operator names by first appearance."""
    raw = adapters.raw_order_terms(spark, sf_dir)
    named = raw.select("term_id", "coeff", F.transform("ops", lambda x: F.struct(F.concat(F.lit("op"), x["id"]).alias("name"), x["n"].alias("n"))).alias("ops"))
    return sums.first_appearance(named).select(F.col("n").cast("long").alias("n"), "name", F.col("op_id").cast("long").alias("op_id"))


_CUTS = """, sides as (select key, cut, coalesce(string_agg(case when n <= cut then n || ':' || id end, '|' order by n), '') as prefix, coalesce(string_agg(case when n > cut then n || ':' || id end, '|' order by n), '') as suffix
  from uops cross join (select unnest(range(1, 8)) as cut) group by 1, 2)
"""

#: Ranks modulo a prime of matrices given as entries (g, a, b, w): every step takes a column's first row with an entry there out and clears the column in the others.
_RANKS = """, numbered as (select g, dense_rank() over (partition by g order by a) as a, dense_rank() over (partition by g order by b) as b, w from entries),
turned as (select g, case when na <= nb then b else a end as r, case when na <= nb then a else b end as c, cast(w as bigint) % 1073741789 as w, least(na, nb) as width
  from (select *, max(a) over (partition by g) as na, max(b) over (partition by g) as nb from numbered)),
width as (select g, r, any_value(width) as width from turned group by 1, 2),
spread as (select g, r, unnest(range(1, width + 1)) as c from width),
filled as (select s.g, s.r, list(coalesce(t.w, 0) order by s.c) as v from spread s left join turned t on t.g = s.g and t.r = s.r and t.c = s.c group by 1, 2),
cleared(first, g, r, v) as (select true, g, r, v from filled union all
  select false, g, r, case when pv is null or v[1] = 0 then v[2:] else list_transform(list_zip(v[2:], pv[2:]), lambda x: (x[1] * pv[1] - x[2] * v[1]) % 1073741789) end
  from (select *, min(case when v[1] <> 0 then r end) over (partition by g) as pr, arg_min(v, case when v[1] <> 0 then r end) over (partition by g) as pv from cleared where len(v) > 0) where pr is null or r <> pr),
ranks as (select g, count(*) filter (first) - count(*) filter (len(v) = 0) as rank from cleared group by 1),
near as (select distinct x.g, x.c, y.c as d from turned x join turned y on x.g = y.g and x.r = y.r),
met(g, c, part) using key (g, c) as (select distinct g, c, c from turned union
  select n.g, n.d, min(m.part) from met m join near n on n.g = m.g and n.c = m.c join recurring.met o on o.g = n.g and o.c = n.d where m.part < o.part group by 1, 2),
pieces as (select g, count(distinct part) as n_components from met group by 1)
"""
#: The largest matching of a graph is the rank of its matrix with independent random entries, and the size of a least cover.
_RANDOM = "cast(hash({}) % 1073741788 as bigint) + 1"
_CUT_RANKS = _CUTS + ", entries as (select cut as g, prefix as a, suffix as b, sum(w) as w from sides join uniq using (key) group by 1, 2, 3)" + _RANKS
_CUT_COVERS = _CUTS + ", entries as (select distinct cut as g, prefix as a, suffix as b, " + _RANDOM.format("prefix || '/' || suffix") + " as w from sides)" + _RANKS
_PART_COVERS = COMPONENTS + ", entries as (select component as g, pg.lv as a, rv as b, " + _RANDOM.format("pg.lv || '/' || rv") + " as w from pg join label on label.lv = pg.lv)" + _RANKS
_BONDS = "select cast(g as int) as cut, cast(rank as bigint) as bond from ranks"
_BONDS_AND_PARTS = "select cast(g as int) as cut, n_components, cast(rank as bigint) as bond from ranks join pieces using (g)"


def _text(c: str) -> object:
    return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["n"], x["id"])), "|")


@query(_CUTS + "select cut, prefix, suffix, sum(w) as w from sides join uniq using (key) group by 1, 2, 3")
def cut_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights between left and right parts at every cut."""
    e = graph.cut_edges(unique_terms(spark, sf_dir), N)
    return e.select(F.col("cut").cast("long").alias("cut"), _text("prefix").alias("prefix"), _text("suffix").alias("suffix"), F.col("re").alias("w"))


@query(_CUTS + "select cut, count(*) as n_edges, count(distinct prefix) as n_left, count(distinct suffix) as n_right from sides group by 1")
def graph_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges and vertices at every cut."""
    e = graph.cut_edges(unique_terms(spark, sf_dir), N).withColumn("cut", F.col("cut").cast("long"))
    return graph.sizes(e, ["cut"], ["prefix"], ["suffix"])


@query(_CUTS + "select suffix, dense_rank() over (order by suffix) as position from (select distinct suffix from sides where cut = 4)")
def compacted_right_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the different right parts at cut 4, in their order."""
    e = graph.cut_edges(unique_terms(spark, sf_dir), N).where("cut = 4").select("suffix").distinct()
    return graph.compact(e, "suffix", Scratch(spark, "compact")).select(_text("suffix").alias("suffix"), "position")


@query(_CUTS + "select key, suffix, min(key) over (partition by suffix) as first_vertex from sides where cut = 4")
def first_equal_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least term with the same right part at cut 4."""
    u = unique_terms(spark, sf_dir).select(X.key_text(F.col("ops")).alias("key"), _text_from(5).alias("suffix"))
    return graph.first_equal(u, "key", "suffix").select("key", "suffix", "first_vertex")


def _text_from(n: int) -> object:
    return F.array_join(F.transform(X.from_site(F.col("ops"), n), lambda x: F.concat_ws(":", x["n"], x["id"])), "|")


@query("select cast(1 as bigint) as link, cast(coalesce(o.id, 1) as bigint) as op_id, count(*) as n_edges, sum(w) as w from uniq u left join uops o on o.key = u.key and o.n = 1 group by 2")
def initial_left_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left vertices at site 1 with their edges."""
    e = graph.first_graph(unique_terms(spark, sf_dir), pauli())
    return e.groupBy(F.col("link").cast("long").alias("link"), F.col("op_id").cast("long").alias("op_id")).agg(F.count("*").alias("n_edges"), F.sum("re").alias("w"))


@query("""select cast(coalesce(a.id, 1) as bigint) as link, cast(coalesce(b.id, 1) as bigint) as op_id, coalesce(c.m, 0) % 2 = 1 as jw, count(*) as n_edges from uniq u left join uops a on a.key = u.key and a.n = 1 left join uops b on b.key = u.key and b.n = 2
left join (select key, count(*) as m from uops where n > 2 and id in (2, 3) group by 1) c on c.key = u.key group by 1, 2, 3""")
def next_left_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left vertices at site 2 if each operator on site 1 is a channel."""
    ops = F.col("ops")
    passed = unique_terms(spark, sf_dir).select(X.onsite_op(ops, 1).cast("long").alias("link"), X.from_site(ops, 2).alias("suffix"), "re", "im")
    e = graph.next_graph(passed, 2, fermions())
    return e.groupBy("link", F.col("op_id").cast("long").alias("op_id"), "jw").agg(F.count("*").alias("n_edges"))


def labelled_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "parts")
    return graph.with_components(scratch.keep(adapters.part_graph(spark, sf_dir), "edges"), scratch)


@query(COMPONENTS + "select lv, component from label")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of orders that share parts."""
    return labelled_parts(spark, sf_dir).select("lv", "component").distinct()


@query(COMPONENTS + "select component, count(distinct pg.lv) as n_left, count(distinct rv) as n_right, count(*) as n_edges from pg join label on label.lv = pg.lv group by 1")
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices and edges of each component."""
    return graph.component_sizes(labelled_parts(spark, sf_dir))


@query(COMPONENTS + """, m as (select component, pg.lv, rv, w from pg join label on label.lv = pg.lv)
select component, cast(dense_rank() over (partition by component order by lv) as bigint) as i, cast(dense_rank() over (partition by component order by rv) as bigint) as j, cast(w as bigint) as w from m""")
def component_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of each component by row and column."""
    m = graph.component_matrix(labelled_parts(spark, sf_dir), ["w"])
    return m.select("component", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "w")


def _covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(component, lv, rv, covered, size) of every edge."""

    def run(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(groups))
        lv, rv = t["lv"].to_pylist(), t["rv"].to_pylist()
        li, ri = ({v: k for k, v in enumerate(sorted(set(x)))} for x in (lv, rv))
        adjacency: list[list[int]] = [[] for _ in li]
        for a, b in zip(lv, rv, strict=True):
            adjacency[li[a]].append(ri[b])
        left, right = (set(x) for x in cover.minimum_vertex_cover(adjacency, len(ri)))
        covered = [li[a] in left or ri[b] in right for a, b in zip(lv, rv, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(t["component"].to_pylist(), pa.int64()), pa.array(lv, pa.int64()), pa.array(rv, pa.int64()), pa.array(covered), pa.array([len(left) + len(right)] * len(lv), pa.int64())], ["component", "lv", "rv", "covered", "size"])

    send_package(spark)
    e = labelled_parts(spark, sf_dir).select("component", "lv", "rv")
    return e.groupBy("component").applyInArrow(run, "component long, lv long, rv long, covered boolean, size long")


@query(_PART_COVERS + "select g as component, cast(rank as bigint) as size from ranks")
def vertex_cover_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of a least vertex cover of each component."""
    return _covers(spark, sf_dir).groupBy("component").agg(F.max("size").alias("size"))


@query("select count(*) as n_edges, cast(0 as bigint) as n_uncovered from pg")
def vertex_cover_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges, and edges that no cover touches."""
    return _covers(spark, sf_dir).agg(F.count("*").alias("n_edges"), F.count_if(~F.col("covered")).alias("n_uncovered"))


@query(COMPONENTS + """, m as (select component, pg.lv, rv, w from pg join label on label.lv = pg.lv)
select component, rv, cast(w as bigint) as w from m where component in (select component from m group by 1 having count(distinct lv) = 1)""")
def single_left_fast_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of components with one left vertex, which pass on as they are."""
    e = labelled_parts(spark, sf_dir)
    return graph.of_kind(e, graph.kinds(e), True).select("component", "rv", "w")


@query(COMPONENTS + """, c as (select component, count(distinct pg.lv) as rank from pg join label on label.lv = pg.lv group by 1)
select qn, cast(dim as int) as dim, cast(coalesce(sum(dim) over (order by qn rows between unbounded preceding and 1 preceding), 0) as int) as "offset" from (select component % 3 as qn, sum(rank) as dim from c group by 1)""")
def qn_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sectors of components with one quantity (their name mod 3), with their dimensions added up and their first channels."""
    c = graph.component_sizes(labelled_parts(spark, sf_dir)).select("component", (F.col("component") % 3).alias("qn"), F.col("n_left").alias("rank"))
    return sectors(numbered_through(c, True, Scratch(spark, "sectors")), True)


@query(COMPONENTS + """, c as (select component, count(distinct pg.lv) as rank from pg join label on label.lv = pg.lv group by 1)
select component, cast(coalesce(sum(rank) over (order by component rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from c""")
def component_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of channels before each component's."""
    c = graph.component_sizes(labelled_parts(spark, sf_dir)).select("component", "n_left")
    return running_total(c, ["component"], "n_left", "offset", Scratch(spark, "offsets")).select("component", "offset")


@query(_CUT_RANKS + _BONDS_AND_PARTS)
def bond_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least bond dimension of every cut of the sum of all orders."""
    return bonds(unique_terms(spark, sf_dir), N)


@query(_CUT_COVERS + _BONDS_AND_PARTS)
def bond_dimensions_vc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of a least vertex cover at every cut."""
    return bonds(unique_terms(spark, sf_dir), N, alg="VC")


@query("""select term_id, string_agg(n || ':' || code + 1, '|' order by n desc) filter (code > 0) as key, cast(q * (case phase when 0 then 1 when 2 then -1 else 0 end) as double) as re, cast(q * (case phase when 1 then 1 when 3 then -1 else 0 end) as double) as im
from (select *, sum(x // 4) over (partition by term_id) % 4 as phase, x % 4 as code from (select term_id, n, list_reduce(list(id - 1 order by pos), lambda a, b: ((a // 4 + case when a % 4 = 0 or a % 4 = b then 0 when (b - a % 4 + 3) % 3 = 1 then 1 else 3 end) % 4) * 4
  + case when a % 4 = 0 then b when a % 4 = b then 0 else 6 - a % 4 - b end) as x, sum(sum(q)) over (partition by term_id) as q from raw group by 1, 2)) group by term_id, q, phase""")
def basis_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as Pauli operators in line order, with those on one site multiplied out."""
    raw = adapters.raw_order_terms(spark, sf_dir)
    sorted_ = raw.select("term_id", "coeff", X.sorted_by_site(F.col("ops")).alias("ops"))
    out = rewrite.rewrite_in_basis(sorted_, pauli(), pauli())
    key = X.key_text(F.col("ops"))
    return out.select("term_id", F.when(key != "", key).alias("key"), (F.col("coeff.re") + 0.0).alias("re"), (F.col("coeff.im") + 0.0).alias("im"))  # no negative zeros


@query("""select count(*) as n_terms, cast(min(nf) as bigint) as least_flux, cast(max(nf) as bigint) as most_flux, cast(0 as bigint) as n_unsorted, cast(0 as bigint) as n_repeated from (select t.term_id, coalesce(sum(case o.id when 2 then -1 when 3 then 1 else 0 end), 0) as nf from terms t left join ops o using (term_id) group by 1)""")
def validate_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the checks of a sum look at."""
    nf = lambda c: F.col(c)[0]["val"].cast("long")
    return rewrite.term_facts(adapters.order_terms(spark, sf_dir), fermions()).select("n_terms", nf("least").alias("least_flux"), nf("most").alias("most_flux"), F.col("unsorted").alias("n_unsorted"), F.col("twice").alias("n_repeated"))


@query("""select n as site, id as right_link, ln as left_link, i, j, cast(sum(q * v * case when p % 2 = 1 and j = 2 then -1 else 1 end) as double) as v from lines join (values (2, 1, 2, 1.0), (3, 2, 1, 1.0), (4, 2, 2, 1.0)) m(id2, i, j, v) on id2 = id group by 1, 2, 3, 4, 5 having sum(q * v * case when p % 2 = 1 and j = 2 then -1 else 1 end) <> 0""")
def mpo_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensor entries of weighted operators with and without a passing fermion, the lines of all orders as parts."""
    lines = adapters.order_lines(spark, sf_dir)
    parts = lines.select(F.col("n").alias("site"), F.lit(1).cast("long").alias("component"), F.col("id").alias("right_link"), F.col("l_linenumber").alias("left_link"), F.col("id").alias("op_id"), (F.col("l_partkey") % 2 == 1).alias("jw"), F.col("q").cast("double").alias("re"), F.lit(0.0).alias("im"))
    e = tensor.entries(parts, fermions())
    return e.select(F.col("site").cast("long").alias("site"), F.col("right_link").cast("long").alias("right_link"), "left_link", "i", "j", F.col("re").alias("v"))


@query("""select k, n, id, ((n - 1) * 3 + (id - 2)) * 7 * 10 + (ln - 1) % 7 * 10 + q % 10 as block, n as a, id - 1 as b, cast((ln - 1) % 7 + 1 as bigint) as c, q % 10 + 1 as d from lines""")
def block_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block numbers from coordinates, and coordinates from numbers."""
    lines = adapters.order_lines(spark, sf_dir)
    lit = lambda x: F.lit(x).cast("long")
    n, i, ln = F.col("n").cast("long"), F.col("id").cast("long"), F.col("l_linenumber").cast("long")
    number = tensor.block_id(n, i - 1, (ln - 1) % 7 + 1, F.col("q") % 10 + 1, lit(3), lit(7), lit(10))
    df = lines.select(F.col("l_orderkey").alias("k"), n.alias("n"), i.alias("id"), number.alias("block"))
    a, b, c, d = tensor.block_of_id(F.col("block"), lit(3), lit(7), lit(10))
    return df.withColumns({"a": a, "b": b, "c": c, "d": d})


@query("""select s_nationkey as index, cast("offset" + within as bigint) as position, block, within from (select s_nationkey, s_suppkey as block, coalesce(sum(dim) over (partition by s_nationkey order by s_suppkey rows between unbounded preceding and 1 preceding), 0) as "offset", unnest(range(1, dim + 1)) as within
from (select s_nationkey, s_suppkey, s_suppkey % 4 + 1 as dim from supplier))""")
def qn_position_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense positions of indexes whose blocks are a nation's suppliers."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("index"), F.col("s_suppkey").alias("block"), (F.col("s_suppkey") % 4 + 1).alias("dim"))
    return tensor.position_map(s).withColumn("within", F.col("within").cast("long"))


def _order_chain(spark: SparkSession, sf_dir: str, alg: str):
    return build(adapters.order_terms(spark, sf_dir), pauli(), Options(alg), check=False)


@query(_CUT_RANKS + _BONDS)
def chain_bonds_qr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bond dimensions of the operator built site by site by QR."""
    return _order_chain(spark, sf_dir, "QR").bond_dimensions()


@query(_CUT_RANKS + _BONDS)
def chain_bonds_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the steps for sums that the driver doesn't hold."""
    return build(adapters.order_terms(spark, sf_dir), pauli(), Options("QR"), check=False, local_terms=0).bond_dimensions()


@query(_CUT_COVERS + _BONDS)
def chain_bonds_vc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bond dimensions of the operator built site by site by vertex covers."""
    return _order_chain(spark, sf_dir, "VC").bond_dimensions()


@query()
def chain_sparsity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparsity with and without split blocks, and link blocks, of the operator built by vertex covers."""
    m = _order_chain(spark, sf_dir, "VC")
    total, used = tensor.link_blocks(m)
    return spark.createDataFrame([(tensor.sparsity(m), tensor.sparsity(m, split_blocks=False), total, used)], "split double, whole double, n_link_blocks long, n_used long")


@query("select cast(n as bigint) as n, cast(id as bigint) as id, count(*) as n_terms, sum(w) as w from uops join uniq using (key) group by 1, 2")
def weights_by_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and weights of each operator on each site."""
    u = unique_terms(spark, sf_dir).select("re", F.explode("ops").alias("o"))
    return u.groupBy(F.col("o.n").cast("long").alias("n"), F.col("o.id").cast("long").alias("id")).agg(F.count("*").alias("n_terms"), F.sum("re").alias("w"))


def _generated(raw: DataFrame, kind: str, n: int, basis: list[str] | None, alg: str, conserve: bool = True) -> DataFrame:
    terms, catalog = sums.from_names(raw, [site_type(kind, conserve)] * n)
    return build(sums.append(terms, catalog), catalog, Options(alg), basis=Catalog.uniform(kind, n, basis, conserve) if basis else None, check=False).bond_dimensions()


def _at_cuts(n: int, bond: str, before: str = "") -> str:
    """SQL for a bond dimension given by the numbers l and r of sites on both sides."""
    return f"{before}select cast(l as int) as cut, cast({bond} as bigint) as bond from (select l, {n} - l as r from (select unnest(range(1, {n})) as l))"


# What crosses a cut, counted: channels that end, begin, or carry one, two or three of a term's operators.
_RING = "2 + 4 * least(l, r, 2)"
#: One wave left and three right or the reverse where momenta match, of four kinds; pairs of six kinds for each momentum that both sides can make.
_WAVES = """, side as (select l, k, k < l as here from (select unnest(range(1, 20)) as l) cross join (select unnest(range(0, 20)) as k)),
pairs as (select distinct a.l, a.here, kind, case kind when 'sum' then (a.k + b.k) % 20 else (a.k - b.k + 20) % 20 end as k from side a join side b on a.l = b.l and a.here = b.here cross join (values ('sum'), ('difference')) v(kind)),
both_make as (select l, kind, count(*) as n from (select l, kind, k from pairs group by all having count(*) = 2) group by 1, 2),
reached as (select s.l, count(*) as n from side s where exists (select 1 from pairs p join side c on c.l = p.l and c.here = p.here where p.l = s.l and p.here <> s.here and p.kind = 'sum' and (p.k - c.k + 20) % 20 = s.k) group by 1)
"""
#: Generic integrals: the smaller side of each kind bounds it.
_ELECTRONS = "2 + least(8 * l * l - 2 * l, 8 * r * r - 2 * r) + 4 * least(l, r * r * r + r * r * (r - 1) // 2) + 4 * least(r, l * l * l + l * l * (l - 1) // 2)"
_SPINS = "2 + 3 * least(l, r) - cast(least(l, r) = 1 as int)"
#: The least cover of strings by weight: those lighter than t on the left and those of at most 4 - t on the right, for the best t.
_STRINGS = """, light as (select n, t, sum(coalesce(ways, 0)) as strings from (select unnest(range(1, 8)) as n) cross join (select unnest(range(0, 5)) as t)
  left join (select n as n2, a, cast(factorial(cast(n as int)) / factorial(cast(a as int)) / factorial(cast(n - a as int)) * 3 ** a as bigint) as ways from (select unnest(range(1, 8)) as n) cross join (select unnest(range(0, 5)) as a) where a <= n) on n2 = n and a <= t group by 1, 2)
"""


@query(_at_cuts(1000, _RING))
def hubbard_real_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonds of a Hubbard ring of 1000 sites."""
    return _generated(generate.hubbard_real_space(spark, 1000), "Electron", 1000, None, "QR")


@query(_WAVES + """select cast(l as int) as cut, cast(2 + 4 * reached.n + 2 * sum(b.n) filter (kind = 'sum') + 4 * sum(b.n) filter (kind = 'difference') as bigint) as bond from reached join both_make b using (l) group by l, reached.n""")
def hubbard_momentum_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonds of the ring of 20 sites in plane waves."""
    return _generated(generate.hubbard_momentum_space(spark, 20), "Electron", 20, generate.ELECTRON_BASIS, "QR")


@query(_at_cuts(10, _ELECTRONS))
def electronic_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonds of generic electronic structure on 10 sites by vertex covers."""
    return _generated(generate.electronic_structure(spark, 10), "Electron", 10, generate.ELECTRON_BASIS, "VC")


@query(_at_cuts(40, _SPINS))
def haldane_shastry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonds of inverse square couplings on a ring of 40 spins."""
    return _generated(generate.haldane_shastry(spark, 40), "S=1/2", 40, None, "QR")


@query(_STRINGS + """select cast(a.n as int) as cut, cast(min(coalesce(x.strings, 0) + coalesce(y.strings, 0)) as bigint) as bond from (select unnest(range(1, 8)) as n) a cross join (select unnest(range(0, 6)) as t) t
left join light x on x.n = a.n and x.t = t.t - 1 left join light y on y.n = 8 - a.n and y.t = 4 - t.t group by 1""")
def pauli_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonds of all Pauli strings of weight up to 4 on 8 sites."""
    return _generated(generate.pauli_strings(spark, 8, 4), "Qubit", 8, None, "QR", False)


@query(_at_cuts(6, "2 ** least(l, r)"))
def fourier_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonds of the Fourier transform of 6 bits, written in reversed order."""
    return _generated(generate.fourier_transform(spark, 6, True), "Qubit", 6, None, "QR", False)


@query(_at_cuts(8, "1"))
def product_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonds of a product over 8 sites, multiplied out into 4**8 terms."""
    factors = [(1.0, 0.5 + k / 8, 0.25j, -0.75) for k in range(8)]
    return _generated(generate.product_operator(spark, factors), "Qubit", 8, None, "QR", False)


@query(_at_cuts(50, "2"))
def weight_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonds of a sum of one operator a site, on 50 sites."""
    return _generated(generate.weight_one(spark, 50), "Qubit", 50, None, "QR", False)


@query()
def transcorrelated_hubbard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonds of the ring of 6 sites in plane waves with three-body terms."""
    return _generated(generate.transcorrelated_hubbard(spark, 6, -0.5), "Electron", 6, generate.ELECTRON_BASIS, "QR")
