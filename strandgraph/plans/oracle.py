"""DuckDB SQL for the queries of queries.py. Column names and rounding are theirs."""

from __future__ import annotations

from .graphs import SQL
from .queries import ALPHA, CODES, ITERATIONS, JUMP, POWERS, SMALL, START, TH, WS

LENGTH = "length(bin({v}))"


def _zeta(k: int) -> tuple[str, str]:
    """(bits, length) of v in zeta_k."""
    h = f"((length(bin(v+1))-1)//{k})"
    low = f"(1::bigint << ({h}*{k})::bigint)"
    y, s = f"(v+1-{low})", f"(({h}+1)*{k})"
    short = f"case when {s}=1 then '' else lpad(bin({y}), ({s}-1)::int, '0') end"
    bits = f"repeat('0',({h})::int)||'1'||case when {y}<{low} then {short} else lpad(bin({y}+{low}), ({s})::int, '0') end"
    return bits, f"(({h}+1)*{k + 1} - case when v+1 < (1::bigint << ({h}*{k}+1)::bigint) then 1 else 0 end)"


_GAMMA = "case when {x}=0 then '1' else repeat('0', length(bin({x}))::int)||bin({x}) end"
_N = "length(bin(v))"
_NIBBLE = f"(({_N}+2)//3)"
BITS = {
    "unary": "repeat('0', v::int)||'1'",
    "gamma": _GAMMA.format(x="v"),
    "delta": f"case when v=0 then '1' else {_GAMMA.format(x=f'{_N}::bigint')}||substr(bin(v),2) end",
    "nibble": f"array_to_string(list_transform(range(1,{_NIBBLE}+1), lambda i: (case when i={_NIBBLE} then '1' else '0' end)||substr(lpad(bin(v),({_NIBBLE}*3)::int,'0'),((i-1)*3+1)::bigint,3)),'')",
} | {f"zeta{k}": _zeta(k)[0] for k in (1, 2, 3)}
LENGTHS = {
    "unary": "v+1",
    "gamma": f"case when v=0 then 1 else 2*{_N} end",
    "delta": f"case when v=0 then 1 else 2*length(bin({_N}::bigint))+{_N}-1 end",
    "nibble": f"4*{_NIBBLE}",
} | {f"zeta{k}": _zeta(k)[1] for k in (1, 2, 3)}

_VALUES = f"(select distinct v from (select unnest(range({SMALL}))::bigint v union all select (1::bigint << i)+d from range(11,{POWERS}) a(i), (values (-1),(0),(1)) b(d)))"
_TOP = "(select greatest(max(s),max(t)) from e)"
_NODES = f"nodes as (select unnest(range({_TOP}+1))::bigint v)"
_ZIGZAG = "case when t>=s then 2*(t-s) else 2*(s-t)-1 end"
_GAPS = f"gaps as (select s,t,row_number() over w-1 pos,case when lag(t) over w is null then {_ZIGZAG} else t-lag(t) over w-1 end v from e window w as (partition by s order by t))"
_SIZES = f"{_NODES}, {_GAPS}, sizes as (select v node, coalesce(n,0)::bigint nbits from nodes left join (select s,sum({LENGTHS['zeta2']}) n from gaps group by s) on s=v)"
_OFFSETS = f"{_SIZES}, offsets as (select node, coalesce(sum(nbits) over (order by node rows between unbounded preceding and 1 preceding),0)::bigint start from sizes)"
_RANKED = "src as (select s,dense_rank() over(order by s) r from (select distinct s from e)), x as (select e.s,e.t,src.r from e join src using(s))"
_SCORES = f"{_RANKED}, ov as (select a.s,a.r,b.s ref_s,b.r ref_r,count(*) n from x a join x b on a.t=b.t and b.r between a.r-{WS} and a.r-1 group by all)"
_CHOICE = f"{_SCORES}, choice as (select s,ref_s,n from (select *,row_number() over(partition by s order by n desc,ref_r) k from ov) where k=1)"
_MASK = f"{_CHOICE}, mask as (select c.s,c.ref_s,e.t,row_number() over(partition by c.s order by e.t)-1 pos,case when o.s is null then 0 else 1 end copied from choice c join e on e.s=c.ref_s left join e o on o.s=c.s and o.t=e.t)"
_LIST = "string_agg(t::varchar, ',' order by t)"
_RUNS = f"runs as (select s,min(t) low,max(t) high,count(*) size from (select s,t,t-row_number() over(partition by s order by t) g from e) group by s,g having count(*)>={TH})"


def _with(graph: str, ctes: str, select: str, recursive: bool = False) -> str:
    return f"with {'recursive ' * recursive}e as ({SQL[graph]}){', ' * bool(ctes)}{ctes} {select}"


def _bfs(graph: str, starts: list[int], select: str) -> str:
    first = ",".join(f"({s}::bigint,0)" for s in starts)
    walk = f"b(v,l) as (select * from (values {first}) z(v,l) union select e.t,l+1 from b join e on e.s=b.v where l<64), lv as (select v,min(l) l from b group by v)"
    return _with(graph, walk, select, recursive=True)


def _visits(graph: str, start: int) -> str:
    """A first-in-first-out search visits a level in the order of the least shortest paths, compared node by node."""
    walk = f"b(v,l,p) as (select {start}::bigint,0,[{start}::bigint] union all select e.t,l+1,min(list_append(p,e.t)) from b join e on e.s=b.v where l<12 group by e.t,l)"
    own = f"{walk}, f as (select v,min(l) l from b group by v)"
    return _with(graph, own, "select b.v node, b.l::int as level, row_number() over(order by b.l,b.p)-1 visit_pos from b join f on f.v=b.v and f.l=b.l", recursive=True)


def _pagerank(graph: str, compat: bool) -> str:
    """Common tables up to pr; the ranks are those of the last round."""
    init, weight = ("0.0::double", "(1//deg.d)") if compat else ("1.0::double/n", "(1.0::double/deg.d)")
    new = f"{ALPHA}/nn.n+{1 - ALPHA}*coalesce(c.c,0)"
    new = f"case when deg.s is null then a.p else {new} end" if compat else new
    return f"""with recursive e as ({SQL[graph]}), nn as (select {_TOP}+1 n), nodes as (select unnest(range((select n from nn)))::bigint v),
 deg as (select s,count(*) d from e group by s),
 pr(it,v,p) as (select 0,v,{init} from nodes,nn union all
  select it,v,p+(1-sum(p) over())/(select n from nn) from (
   select a.it+1 it,a.v,{new} p from pr a cross join nn left join deg on deg.s=a.v
   left join (select e.t,sum(pr.p*{weight}) c from pr join deg on deg.s=pr.v join e on e.s=pr.v group by e.t) c on c.t=a.v
   where a.it<{ITERATIONS}))"""


def _edges(graph: str) -> str:
    return _with(graph, "", "select s src, t dst from e")


def oracle_sql() -> dict[str, str]:
    ranks = f" select v node, round(p,12) rank from pr where it={ITERATIONS}"
    out = {
        "edge_scan": _edges("part_supp"),
        "graph_stats": _with("sparse", "", f"select {_TOP} max_id, {_TOP}+1 num_ids, count(*) links, (select max(n) from (select count(*) n from e group by s)) max_degree from e"),
        "out_degree": _with("supp_part", "", "select s src, count(*) degree from e group by s"),
        "degree_histogram": _with("cust_order", "", "select degree, count(*) nodes from (select count(*) degree from e group by s) group by degree"),
        "max_degree": _with("part_supp", "", "select max(n) max_degree from (select count(*) n from e group by s)"),
        "sinks": _with("supp_part", "", "select distinct t node from e where t not in (select s from e)"),
        "has_successors": _with("sparse", _NODES, "select v node, case when v in (select s from e) then 1 else 0 end has_succ from nodes"),
        "self_loops": _with("user_seq", "", "select s src, t dst from e where s=t"),
        "sort_validate": "select count(*) violations from (select l_partkey s, l_suppkey t, lag(l_partkey) over w ps, lag(l_suppkey) over w pt from lineitem window w as (order by l_orderkey, l_linenumber, l_partkey, l_suppkey)) where ps > s or (ps = s and pt >= t)",
        "sort_validate_text": "select 0::bigint violations",
        "edges_sorted": _with("part_supp", "", "select s src, t dst, row_number() over(order by s,t)-1 place from e"),
        "renumber_map": _with("sparse", "", "select old old_id, dense_rank() over(order by old)-1 new_id from (select s old from e union select t from e)"),
        "adjacency_list": _with("part_supp", "", f"select s node, {_LIST} succ from e group by s"),
        "adjacency_filled": _with("sparse", _NODES, f"select v node, coalesce(l,'') succ from nodes left join (select s, {_LIST} l from e group by s) on s=v"),
        "successors_point_lookup": _with("part_supp", "", "select t dst from e where s=42"),
        "zigzag": _with("user_seq", "", f"select s src, t dst, {_ZIGZAG} z from e"),
        "zigzag_inverse": _with("user_seq", "", f"select s src, {_ZIGZAG} z, t dst from e"),
        "gap_transform": _with("supp_part", _GAPS, "select s src, t dst, v gap from gaps"),
        "gap_inverse": _edges("supp_part"),
        "minimal_binary": """with p as (select x,top from range(70) a(top), range(70) b(x) where x<=top),
 q as (select x,top,top+1 z,length(bin(top+1)) s from p), r as (select *,(1::bigint << s::bigint)-z short from q)
 select x::bigint x, top::bigint top, case when x<short then (case when s=1 then '' else lpad(bin(x),(s-1)::int,'0') end) else lpad(bin(x+short),s::int,'0') end bits from r""",
        "g_list_bits": _with("user_seq", _GAPS, f"select s node, string_agg({BITS['zeta2']}, '' order by pos) bits from gaps group by s"),
        "g_total_size": _with("part_supp", _SIZES, "select sum(nbits)::bigint list_bits, ((sum(nbits)+7)//8)::bigint list_bytes, (8*(count(*)+1))::bigint index_bytes from sizes"),
        "g_offsets": _with("part_supp", _OFFSETS, "select node, start from offsets"),
        "sparse_index_jump": _with("part_supp", _OFFSETS, f"select node, start from offsets where node%{JUMP}=0"),
        "g_bytes_hex": _with("user_seq", f"{_GAPS}, words as (select s, string_agg({BITS['zeta2']}, '' order by pos) b from gaps group by s)",
            "select s node, array_to_string(list_transform(range(0,(length(b)+7)//8), lambda i: printf('%02X', list_sum(list_transform(range(0,8), lambda j: case when substr(b,(i*8+j+1)::bigint,1)='1' then (1::bigint << j) else 0 end))::bigint)),'') packed from words"),
        "code_comparison": _with("part_supp", _GAPS, " union all ".join(f"select '{c}' code, sum({LENGTHS[c]})::bigint total_bits from gaps" for c in CODES)),
        "window_candidates": _with("supp_part", _RANKED, f"select a.s src, b.s ref_src from src a join src b on b.r between a.r-{WS} and a.r-1"),
        "overlap_scores": _with("user_seq", _SCORES, "select s src, ref_s ref_src, n common from ov"),
        "reference_choice": _with("part_supp", _CHOICE, "select s src, ref_s ref_src, n common from choice"),
        "first_reference_unbounded": _with("part_supp", _CHOICE, "select s src, ref_s ref_src, n common from choice"),
        "copy_mask": _with("user_seq", _MASK, "select s src, ref_s ref_src, t dst, copied from mask"),
        "copy_blocks": _with("user_seq", f"{_MASK}, turns as (select *,case when copied<>coalesce(lag(copied) over(partition by s order by pos),1) then 1 else 0 end turn from mask), numbered as (select *,sum(turn) over(partition by s order by pos)::bigint block from turns)",
            "select s src, block, copied, count(*) size from numbered group by s,block,copied"),
        "intervals": _with("supp_part", _RUNS, "select s src, low, high, size from runs"),
        "interval_encoding": _with("supp_part", _RUNS, f"select s src, low, case when before is null then abs(low-s) else low-before-2 end left_value, case when before is null then (case when low<s then 1 else 0 end) end sign, size-{TH} length_value from (select *,lag(high) over(partition by s order by low) before from runs)"),
        "residuals": _with("user_seq", f"{_MASK}, rest as (select s,t from e where not exists (select 1 from mask m where m.s=e.s and m.t=e.t and m.copied=1)), isl as (select s,t,t-row_number() over(partition by s order by t) g from rest), kept as (select s,t from (select *,count(*) over(partition by s,g) n from isl) where n<{TH})",
            f"select s src, t dst, case when lag(t) over w is null then {_ZIGZAG} else t-lag(t) over w-1 end gap from kept window w as (partition by s order by t)"),
        "intersection_difference": _with("user_seq", f"{_CHOICE}, m as (select c.s,c.ref_s,e.t,case when o.s is null then 0 else 1 end c from choice c join e on e.s=c.s left join e o on o.s=c.ref_s and o.t=e.t)",
            "select s src, ref_s ref_src, coalesce(string_agg(t::varchar, ',' order by t) filter (c=1),'') common, coalesce(string_agg(t::varchar, ',' order by t) filter (c=0),'') extra from m group by s,ref_s"),
        "chain_invariants": "select 0::bigint violations",
        "compressed_point_lookup": _with("part_supp", "", "select t dst from e where s=42"),
        "compressed_report": _with("part_supp", _SIZES, f"select {_TOP} max_id, (select count(*) from e) links, sum(nbits)::bigint list_bits, ((sum(nbits)+7)//8)::bigint list_bytes, (8*({_TOP}+2))::bigint index_bytes from sizes"),
        "compressed_write_read": _edges("user_seq"),
        "text_edge_list_roundtrip": _edges("order_cust"),
        "bfs_levels": _bfs("part_supp", [START], "select v node, l::int as level from lv"),
        "bfs_visit_order": _visits("user_seq", START),
        "bfs_count": _bfs("part_supp", [START], "select count(*) reached from lv"),
        "bfs_multi_start": _bfs("order_cust", [1, 7, 99], "select v node, l::int as level from lv"),
        "pagerank_standard": _pagerank("user_seq", False) + ranks,
        "pagerank_compat": _pagerank("order_cust", True) + ranks,
        "pagerank_sinks": _pagerank("part_supp", False) + ranks,
        "pagerank_sum": _pagerank("user_seq", False) + f" select round(sum(p),9) total from pr where it={ITERATIONS}",
        "pagerank_topk": _pagerank("user_seq", False) + ranks + " order by round(p,12) desc, v limit 10",
        "pagerank_requested_nodes": _pagerank("user_seq", False) + ranks + " and v in (0,1,5,14)",
    }
    for name, start in (("renumber_edges", 0), ("renumber_from_one", 1)):
        ids = f"m as (select old, dense_rank() over(order by old)-1+{start} nw from (select s old from e union select t from e))"
        out[name] = _with("sparse", ids, "select a.nw src, b.nw dst from e join m a on a.old=s join m b on b.old=t")
    for c in CODES:
        out[f"len_{c}"] = f"select v, ({LENGTHS[c]})::bigint n from {_VALUES}"
        out[f"bits_{c}"] = f"select v, {BITS[c]} bits from {_VALUES}" + f" where v<{SMALL}" * (c == "unary")
    for variant in ("G", "CL", "CB", "I", "final"):
        out[f"stream_{variant}"] = _edges("user_seq")
        out[f"bfs_{variant}"] = _bfs("user_seq", [START], "select v node, l::int as level from lv")
    for variant, graph in (("G", "supp_part"), ("CL", "part_supp"), ("CB", "user_seq"), ("I", "part_supp"), ("final", "part_supp")):
        out[f"roundtrip_{variant}"] = _edges(graph)
    return out
