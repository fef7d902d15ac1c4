"""DuckDB SQL for those of the ten operators that SQL can express. The others are tested against brute force."""

from __future__ import annotations

from .licences import TEMPLATES, THRESHOLD
from .mixing import LARGEST, SEED
from .quality_rules import RULES

_WORDS = r"regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _count(pattern: str) -> str:
    return f"length(regexp_replace(t, '[^{pattern}]+', '', 'g'))"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _components(nodes: str) -> str:
    """Common tables that end in comp(v, c): the least node that each of table nodes reaches by link(a, b)."""
    return f"""both_ways as (select a, b from link union select b, a from link),
 reach(v, r) as (select v, v from {nodes} union select reach.v, both_ways.b from reach join both_ways on both_ways.a = reach.r),
 comp as (select v, min(r) c from reach group by v)"""


def _licences() -> str:
    rows = ",".join(f"({k},{_quote(name)},{_quote(text)})" for k, (name, text) in enumerate((n, t) for n in sorted(TEMPLATES) for t in TEMPLATES[n]))
    plain = "regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\\n]+', ' ', 'g')"
    line = "string_split(trim(regexp_replace({}, '[ \\n]+', ' ', 'g'), ' '), ' ')"
    grams = "select distinct {key}, ws[i]||' '||ws[i+1] g from (select *, unnest(range(1, len(ws))) i from {rows})"
    return f"""with tpl(k, name, txt) as (values {rows}),
 tw as (select k, name, {line.format(plain.format('txt'))} ws from tpl),
 tg as ({grams.format(key='k, name', rows='tw')}), ts as (select k, name, count(*) m, any_value(len(ws)) n from tg join tw using (k, name) group by all),
 norm as (select doc_id, {plain.format("coalesce(text,'')")} t from documents),
 raw as (select doc_id, unnest(list_concat(list_concat(string_split(t, chr(10)), string_split_regex(t, '\\n(?: ?\\n)+')), [t])) u from norm),
 units as (select distinct doc_id, {line.format('u')} ws from raw),
 uw as (select doc_id, array_to_string(ws, ' ') u, ws from units where len(ws) > 1),
 ug as ({grams.format(key='doc_id, u', rows='uw')}), us as (select doc_id, u, count(*) a from ug group by all),
 common as (select ug.doc_id, ug.u, tg.k, count(*) n from ug join tg using (g) group by all),
 hits as (select c.doc_id, c.u, ts.name, 2.0::double*c.n/(us.a+ts.m) dice from common c join us on us.doc_id=c.doc_id and us.u=c.u join ts on ts.k=c.k where 2.0::double*c.n/(us.a+ts.m) >= {THRESHOLD}),
 whole as (select doc_id, {line.format('t')} ws from norm),
 spots as (select doc_id, p, ws[p]||' '||ws[p+1] g from (select *, unnest(range(1, len(ws))) p from whole)),
 near as (select spots.doc_id, tg.k, count(distinct g) c from spots join tg using (g) group by all),
 starts as (select spots.doc_id, ts.k, ts.name, ts.m, ts.n, spots.p from spots join tg using (g) join ts on ts.k=tg.k join near on near.doc_id=spots.doc_id and near.k=tg.k where near.c >= 0.66*ts.m),
 slid as (select s.doc_id, s.name, s.k, s.m, s.p, count(distinct spots.g) a, count(distinct case when tg.g is not null then spots.g end) c
  from (select *, unnest(range(p, p+n-1)) q from starts) s join spots on spots.doc_id=s.doc_id and spots.p=s.q left join tg on tg.k=s.k and tg.g=spots.g group by all),
 best as (select doc_id, name, dice from hits union all select doc_id, name, 2.0::double*c/(a+m) from slid where 2.0::double*c/(a+m) >= {THRESHOLD}),
 one as (select doc_id, dice, name, row_number() over (partition by doc_id order by dice desc, name) r from best),
 n as (select doc_id, count(distinct u) n from hits group by doc_id)
 select d.doc_id, one.name licence, round(coalesce(one.dice, 0.0::double), 9) dice, coalesce(n.n, 0) n_licence_units
 from documents d left join one on one.doc_id=d.doc_id and one.r=1 left join n on n.doc_id=d.doc_id"""


def _substrings() -> str:
    return f"""with w as (select doc_id, {_WORDS} ws from documents),
 win as (select doc_id, i, array_to_string(ws[i:i+19], ' ') k from (select *, unnest(range(1, greatest(len(ws)-18, 1))) i from w)),
 rep as (select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id, i) r from win) where r > 1),
 gone as (select distinct doc_id, i+j p from rep, range(20) z(j)),
 word as (select doc_id, unnest(ws) word, unnest(range(1, len(ws)+1)) p from w),
 kept as (select word.doc_id, string_agg(word, ' ' order by word.p) txt, count(*) n from word left join gone on gone.doc_id=word.doc_id and gone.p=word.p where gone.p is null group by word.doc_id)
 select w.doc_id, len(w.ws) n_words, len(w.ws)-coalesce(kept.n, 0) n_removed, sha256(coalesce(kept.txt, '')) kept_sha256 from w left join kept on kept.doc_id=w.doc_id"""


def _near() -> str:
    words = _WORDS.replace("coalesce(text,'')", _LOWER)
    return f"""with recursive w as (select doc_id, {words} ws from documents),
 sh as (select distinct doc_id, case when len(ws) < 4 then array_to_string(ws, ' ') else array_to_string(ws[i:i+3], ' ') end g from (select *, unnest(range(1, greatest(len(ws)-2, 2))) i from w where len(ws) > 0)),
 n as (select doc_id, count(*) n from sh group by doc_id),
 pairs as (select a.doc_id a, b.doc_id b, count(*) c from sh a join sh b on a.g = b.g and a.doc_id < b.doc_id group by all),
 link as (select a, b from pairs join n x on x.doc_id=a join n y on y.doc_id=b where 100*c >= 80*(x.n+y.n-c)),
 ids as (select doc_id v from documents), {_components('ids')}
 select d.doc_id, coalesce(n.n, 0) n_shingles, comp.c component_id, d.doc_id = comp.c kept from documents d left join n on n.doc_id=d.doc_id join comp on comp.v=d.doc_id"""


def _vectors() -> str:
    return f"""with recursive e as (select vec_id, embedding::double[] x from embeddings where embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v)))=0 and len(list_filter(embedding, lambda v: v<>0))>0),
 link as (select p.vec_id a, q.vec_id b from e p join e q on p.vec_id < q.vec_id and len(p.x)=len(q.x) where list_cosine_similarity(p.x, q.x) >= 0.95),
 ids as (select vec_id v from embeddings), {_components('ids')},
 deg as (select a, count(*) n from both_ways group by a)
 select v vec_id, coalesce(deg.n, 0) n_links, c component_id, v = c kept from comp left join deg on deg.a = v"""


def _rules() -> str:
    fails = " or ".join(f"({r.sql()})" for r in RULES)
    base = " or ".join(f"({r.sql()})" for r in RULES if r.base)
    return f"""with w as (select doc_id, coalesce(text,'') t, {_WORDS} ws from documents),
 win as (select doc_id, i, array_to_string(ws[i:i+7], ' ') k from (select *, unnest(range(1, greatest(len(ws)-6, 1))) i from w)),
 rep as (select doc_id, count(distinct i+j) n from (select doc_id, i, count(*) over (partition by doc_id, k) c from win), range(8) z(j) where c > 1 group by doc_id),
 lines as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) l from w),
 m as (select w.doc_id, len(ws) n_words, length(array_to_string(ws, '')) word_chars, {_count('#*$%&|<>')} n_symbols, len(l) n_lines, len(l)-len(list_distinct(l)) n_dup_lines,
  coalesce(rep.n, 0) n_repeat_words, len(list_filter(range(1, greatest(len(ws), 1)), lambda i: ws[i] = ws[i+1])) n_echoes, {_count(chr(92) + 'p{Lu}')} n_upper, {_count(chr(92) + 'p{L}')} n_letters
  from w join lines on lines.doc_id=w.doc_id left join rep on rep.doc_id=w.doc_id)
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) base_failed, not ({fails}) kept from m"""


def _mixing() -> str:
    """Probabilities by the logarithm of the gamma function, so none is made from the one before it."""
    u = f"('0x'||substr(md5('{SEED}:'||k{{}}),1,13))::bigint/4503599627370496.0::double"
    return f"""with c as (select source, count(*) n from documents group by source),
 rates as (select source, (select sum(n) from c)::double/(select count(*) from c)::double/n rate from c),
 drawn as (select source, greatest(1, ceil(rate/{LARGEST}))::bigint parts, rate/greatest(1, ceil(rate/{LARGEST})) r from rates),
 cdf as (select source, sum(exp(k*ln(r)-r-lgamma(k+1))) over (partition by source order by k) s from (select *, unnest(range(0, ceil(r+12*sqrt(r)+24)::bigint+1)) k from drawn)),
 d as (select *, coalesce(doc_id::varchar,'')||':'||md5(coalesce(text,''))||':'||coalesce(source,'') k from documents),
 ids as (select row_number() over () row_id, d.*, drawn.parts from d join drawn on drawn.source is not distinct from d.source),
 draws as (select row_id, source, case when part=1 then {u.format('')} else {u.format("||':'||part||':part'")} end u from (select *, unnest(range(1, parts+1)) part from ids)),
 counts as (select row_id, sum((select count(*) from cdf where cdf.source is not distinct from draws.source and cdf.s <= u))::bigint n from draws group by row_id)
 select doc_id, text, lang, source, n_chars, unnest(range(1, n+1))::int copy from ids join counts using (row_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scans": _licences(),
        "op4_substring_dedup": _substrings(),
        "op6_minhash": _near(),
        "op7_cap_filters": _vectors(),
        "op9_quality_rules": _rules(),
        "op10_mixing": _mixing(),
    }
