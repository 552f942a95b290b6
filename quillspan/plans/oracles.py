"""The span queries in SQL, built from shared parts."""

from __future__ import annotations

from quillspan.plans.tables import SQL as TABLES

WITH = f"with recursive {TABLES}"

UNION = """
{name}_open as (select *, case when max("end") over w is null or "start" > max("end") over w then 1 else 0 end o from {source}
  window w as (partition by {keys} order by "start", "end" rows between unbounded preceding and 1 preceding)),
{name}_run as (select *, sum(o) over (partition by {keys} order by "start", "end" rows unbounded preceding) island from {name}_open),
{name} as (select {keys}, min("start") "start", max("end") "end" from {name}_run group by {keys}, island)"""

SCOPED = """
scoped as (select doc_id, phi_type, "start", "end", unnest(['all',
  case when layer = 'tagger' then 'family:tagger' else 'family:rules' end, 'layer:' || layer]) scope from pred)"""

COVER = f"""{SCOPED},{UNION.format(name="isl", source="scoped", keys="doc_id, phi_type, scope")},
cov as (select g.doc_id, g.span_index, g.phi_type, g."start", g."end", i.scope,
  sum(greatest(0, least(g."end", i."end") - greatest(g."start", i."start"))) n
  from gold g left join isl i on g.doc_id = i.doc_id and g.phi_type = i.phi_type and g."start" < i."end" and i."start" < g."end"
  group by all)"""


def covered(mode: str) -> str:
    test = 'coalesce(n, 0) = "end" - "start"' if mode == "fully_covered" else "coalesce(n, 0) > 0"
    return f"""
hit as (select *, {test} ok from cov),
ver as (select doc_id, span_index, phi_type, "start", "end", coalesce(bool_or(ok and scope = 'all'), false) covered,
  coalesce(list_sort(list(scope[8:]) filter (ok and scope like 'family:%')), []) families,
  coalesce(list_sort(list(scope[7:]) filter (ok and scope like 'layer:%')), []) layers from hit group by all)"""


DEDUPED = """
dpred as (select * from pred qualify row_number() over (partition by doc_id, "start", "end", phi_type order by span_index) = 1)"""


def assigned(mode: str) -> str:
    test = 'p."start" <= g."start" and g."end" <= p."end"' if mode == "fully_covered" else 'g."start" < p."end" and p."start" < g."end"'
    return f"""{DEDUPED},
cand as (select g.doc_id, g.phi_type, g.span_index gi, p.span_index pi, row_number() over (partition by g.doc_id, g.phi_type
  order by greatest(0, least(g."end", p."end") - greatest(g."start", p."start")) desc, g."start", g."end", p."start", p."end", p.span_index, g.span_index) r
  from gold g join dpred p on g.doc_id = p.doc_id and g.phi_type = p.phi_type and {test}),
walk as (select doc_id, phi_type, r, gi, pi, true took, [gi] gs, [pi] ps from cand where r = 1
  union all select c.doc_id, c.phi_type, c.r, c.gi, c.pi, not (list_contains(gs, c.gi) or list_contains(ps, c.pi)),
  case when list_contains(gs, c.gi) or list_contains(ps, c.pi) then gs else list_append(gs, c.gi) end,
  case when list_contains(gs, c.gi) or list_contains(ps, c.pi) then ps else list_append(ps, c.pi) end
  from walk w join cand c on c.doc_id = w.doc_id and c.phi_type = w.phi_type and c.r = w.r + 1),
asg as (select doc_id, phi_type, gi gold_index, pi pred_index from walk where took)"""


def matched(mode: str) -> str:
    return f"""{COVER},{covered(mode)},{assigned(mode)},
vm as (select v.*, a.gold_index is not null matched from ver v left join asg a on v.doc_id = a.doc_id and v.span_index = a.gold_index),
dm as (select d.*, a.pred_index is not null matched from dpred d left join asg a on d.doc_id = a.doc_id and d.span_index = a.pred_index)"""


COUNTS = """
types as (select phi_type, count(*) gold, count(*) filter (not covered) leaked, count(*) filter (matched) tp from vm group by 1),
wrong as (select phi_type, count(*) fp from dm where not matched group by 1),
ct as (select coalesce(t.phi_type, w.phi_type) phi_type, coalesce(gold, 0)::bigint gold, coalesce(leaked, 0)::bigint leaked,
  coalesce(tp, 0)::bigint tp, coalesce(fp, 0)::bigint fp, (coalesce(gold, 0) - coalesce(tp, 0))::bigint fn from types t full join wrong w using (phi_type))"""


def ratio(a: str, b: str) -> str:
    return f"(({a})::double / nullif(({b})::double, 0))"


PRF = f"""coalesce({ratio("tp", "tp + fp")}, 0.0) "precision", coalesce({ratio("tp", "tp + fn")}, 0.0) recall,
  coalesce({ratio("2 * tp", "2 * tp + fp + fn")}, 0.0) f1"""


def full(mode: str, body: str, extra: str = "") -> str:
    return f"{WITH},{matched(mode)}{extra} {body}"


def _leak() -> str:
    parts = []
    for mode in ("fully_covered", "relaxed"):
        test = 'coalesce(n, 0) = "end" - "start"' if mode == "fully_covered" else "coalesce(n, 0) > 0"
        parts.append(f"""select '{mode}' mode, count(*) filter (not c)::bigint leaked, count(*)::bigint gold from
          (select doc_id, span_index, phi_type, "start", "end", coalesce(bool_or({test} and scope = 'all'), false) c from cov group by 1, 2, 3, 4, 5)""")
    return f"{WITH},{COVER} select *, {ratio('leaked', 'gold')} leak_rate from ({' union all '.join(parts)})"


ORACLES = {
    "interval_union": f"""{WITH},{UNION.format(name="isl", source="pred", keys="doc_id, phi_type")} select doc_id, phi_type, "start", "end" from isl""",
    "mask_union": f"""{WITH},{UNION.format(name="isl", source="pred", keys="doc_id").replace('"start" > max', '"start" >= max').replace('max("end") "end"', 'max("end") "end", count(distinct phi_type) n_types, min(phi_type) o1')}
select doc_id, "start", "end", n_types, case when n_types = 1 then '[' || o1 || ']' else '[PHI]' end tag from isl""",
    "overlapping_pairs": f"""{WITH} select a.doc_id, count(*) pairs from pred a join pred b on a.doc_id = b.doc_id and a.span_index < b.span_index
  and a."start" < b."end" and b."start" < a."end" group by 1""",
    "dedupe": f"""{WITH} select doc_id, count(*) kept, (sum(n) - count(*))::bigint dropped from
  (select doc_id, "start", "end", phi_type, count(*) n from pred group by all) group by 1""",
    "covered_length": f"{WITH},{COVER} select doc_id, span_index, v n from (select doc_id, span_index, phi_type, \"start\", \"end\", coalesce(max(n) filter (scope = 'all'), 0)::bigint v from cov group by 1, 2, 3, 4, 5)",
    "coverage_fully": f"{WITH},{COVER},{covered('fully_covered')} select doc_id, span_index, covered from ver",
    "coverage_relaxed": f"{WITH},{COVER},{covered('relaxed')} select doc_id, span_index, covered from ver",
    "assign_fully": f"{WITH},{assigned('fully_covered')} select doc_id, gold_index, pred_index from asg",
    "assign_relaxed": f"{WITH},{assigned('relaxed')} select doc_id, gold_index, pred_index from asg",
    "leak_rate": _leak(),
    "counts": f"""{WITH} select (select count(distinct doc_id) from lines) documents, (select count(distinct doc_id) from gold) with_gold,
  (select count(distinct doc_id) from lines) - (select count(distinct doc_id) from gold) without_gold,
  count(*) filter (is_gold and not excluded) in_scope, count(*) filter (is_gold and excluded) excluded,
  {ratio("count(*) filter (is_gold and excluded)", "count(*) filter (is_gold)")} excluded_share, count(*) filter (not is_gold) predictions from lines""",
    "fp_opportunity": f"""{WITH} select count(distinct doc_id) documents, count(*) filter (not is_gold) predictions from lines
  where doc_id not in (select doc_id from gold)""",
    "merge_recall_first": f"""{WITH},{UNION.format(name="isl", source="pred", keys="doc_id").replace('"start" > max', '"start" >= max').replace('max("end") "end"', '''max("end") "end", count(*) n_merged,
  arg_max(phi_type, {'a': "end" - "start", 'b': -list_position(['regex_checksum','context_cue','gazetteer','tagger'], layer), 'c': -"start", 'd': -span_index}) phi_type''')}
select doc_id, "start", "end", phi_type, n_merged from isl""",
}

for _short, _mode in (("fully", "fully_covered"), ("relaxed", "relaxed")):
    ORACLES |= {
        f"by_type_{_short}": full(_mode, f"select phi_type, gold, leaked, {ratio('leaked', 'gold')} leak_rate, tp, fp, fn, {PRF}, gold > 0 and gold <= 8 sparse from ct", f",{COUNTS}"),
        f"macro_{_short}": full(
            _mode,
            f"""select round(avg("precision"), 9) "precision", round(avg(recall), 9) recall, round(avg(f1), 9) f1, round(avg(leak_rate), 9) leak_rate, count(*) n_types
  from (select {ratio('leaked', 'gold')} leak_rate, {PRF} from ct where gold > 0)""",
            f",{COUNTS}",
        ),
        f"by_document_{_short}": full(_mode, f"select count(*) filter (l)::bigint docs_with_leak, count(*) docs_with_gold, {ratio('count(*) filter (l)', 'count(*)')} rate from (select doc_id, bool_or(not covered) l from vm group by 1)"),
        f"slack_{_short}": full(_mode, "select count(*) filter (covered and not matched)::bigint slack from vm"),
        f"by_rule_{_short}": full(
            _mode,
            """select f.rule_id, layer, fires, tp, fp from (select rule_id, min(layer) layer, count(*) fires from pred where rule_id is not null group by 1) f
  join (select o.rule_id, count(*) filter (matched) tp, count(*) filter (not matched) fp from
    (select distinct doc_id, "start", "end", phi_type, rule_id from pred where rule_id is not null) o join dm using (doc_id, "start", "end", phi_type) group by 1) c using (rule_id)""",
        ),
        f"complementarity_families_{_short}": full(
            _mode,
            """select case when list_contains(families, 'rules') and list_contains(families, 'tagger') then 'both' when list_contains(families, 'rules') then 'rules_only'
  when list_contains(families, 'tagger') then 'tagger_only' when covered then 'joint_only' else 'neither' end category, count(*) n from vm group by 1""",
        ),
        f"complementarity_families_by_type_{_short}": full(
            _mode,
            """select phi_type, case when list_contains(families, 'rules') and list_contains(families, 'tagger') then 'both' when list_contains(families, 'rules') then 'rules_only'
  when list_contains(families, 'tagger') then 'tagger_only' when covered then 'joint_only' else 'neither' end category, count(*) n from vm group by 1, 2""",
        ),
        f"complementarity_layers_{_short}": full(_mode, "select phi_type, array_to_string(layers, '|') layers, covered, count(*) n from vm group by 1, 2, 3"),
        f"covered_by_layer_{_short}": full(_mode, "select unnest(layers) layer, count(*) n from vm group by 1"),
    }

_PRF_BOTH = " union all ".join(
    f"select '{m}' mode, * from ({full(m, 'select sum(tp)::bigint tp, sum(fp)::bigint fp, sum(fn)::bigint fn from ct', f',{COUNTS}')})" for m in ("fully_covered", "relaxed")
)
ORACLES["prf_overall"] = f"select mode, tp, fp, fn, {PRF} from ({_PRF_BOTH})"
_ERRORS = f"""select doc_id, span_index, phi_type, 'missed' kind, "start", "end" from ({full("fully_covered", "select * from vm where not covered")})
union all select doc_id, span_index, phi_type, 'false_positive', "start", "end" from ({full("relaxed", "select * from dm where not matched")})"""
ORACLES["error_spans"] = _ERRORS
ORACLES["headline"] = f"""select a.leak_rate, b.leak_rate lower_bound, "precision", recall, f1 from (select leak_rate from ({_leak()}) where mode = 'fully_covered') a,
  (select leak_rate from ({_leak()}) where mode = 'relaxed') b, (select * from ({ORACLES["prf_overall"]}) where mode = 'relaxed') c"""

# --- documents -------------------------------------------------------------------------------------------------

EMAIL = "[A-Za-z0-9._]+@[A-Za-z0-9.]*[A-Za-z0-9]"
CARD = "[0-9]{16}"
ADDRESS = "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"
PHONE = "[+][0-9]{1,3} [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}"
CUE = '(?:password|secret|token)[ :.,="]{0,5}([0-9a-f]{6,})'


def spans(pattern: str, group: int = 0, where: str = "true") -> str:
    """doc_id, start, end, hit of a pattern, by the pieces between matches."""
    return f"""(select doc_id, (e - length(g)) "start", e "end", g hit from (
  select doc_id, g, sum(length(s) + length(m)) over (partition by doc_id order by i rows unbounded preceding) e from (
    select doc_id, unnest(range(1, len(ms) + 1)) i, unnest(ms) m, unnest(gs) g, unnest(segs[1:len(ms)]) s from (
      select doc_id, regexp_extract_all(text, '{pattern}') ms, regexp_extract_all(text, '{pattern}', {group}) gs, string_split_regex(text, '{pattern}') segs from documents)))
  where {where} and length(g) > 0)"""


LUHN = """(select sum(case when (length(g) - j) % 2 = 1 then case when 2 * substr(g, j::int, 1)::int > 9 then 2 * substr(g, j::int, 1)::int - 9 else 2 * substr(g, j::int, 1)::int end
  else substr(g, j::int, 1)::int end) % 10 = 0 from range(1, length(g) + 1) t(j))"""

RULES = (("en:email", "CONTACT", EMAIL, 0, "true"), ("en:address", "ID", ADDRESS, 0, "true"), ("en:card", "ID", CARD, 0, LUHN), ("en:phone", "CONTACT", PHONE, 0, "true"), ("en:credential", "ID", CUE, 1, "true"))
ALL = " union all ".join(f"""select doc_id, "start"::int "start", "end"::int "end", '{i}' rule_id, '{t}' phi_type from {spans(p, g, w)}""" for i, t, p, g, w in RULES)
TOKENS = r"len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> ''))"
FOLDS = "case when doc_id % 4 = 0 then 'dev' when doc_id % 4 = 1 then 'test' else 'train' end"

ORACLES |= {
    "detect_regex": f"""select doc_id, "start"::int "start", "end"::int "end", 'en:email' rule_id from {spans(EMAIL)}""",
    "detect_checksum_luhn": f"""select doc_id, "start"::int "start", "end"::int "end", 'en:card' rule_id from {spans(CARD, 0, LUHN)}""",
    "detect_cue": f"""select doc_id, "start"::int "start", "end"::int "end", 'en:credential' rule_id from {spans(CUE, 1)}""",
    "detect_all": ALL,
    "detect_counts": f"select rule_id, phi_type, count(*) n_spans, count(distinct doc_id) n_docs from ({ALL}) group by 1, 2",
    "context_window": f"""select s.doc_id, s."start", s."end", replace(substr(text, (greatest(s."start" - 120, 0) + 1)::int, (least(s."end" + 120, length(text)) - greatest(s."start" - 120, 0))::int), chr(10), ' ') "window",
  (s."start" - greatest(s."start" - 120, 0))::int "at", (s."end" - greatest(s."start" - 120, 0))::int "to"
  from (select doc_id, "start"::int "start", "end"::int "end" from {spans(EMAIL)}) s join documents using (doc_id)""",
    "screen_documents": r"""select doc_id, case when r is null then 'allowed' else 'suspect' end "class", r reason from (select doc_id,
  case when regexp_matches(text, '(?i)admission date|discharge date|chief complaint|history of present') then 'clinical_header'
  when len(regexp_extract_all(text, '\[\*\*[^\]*]{1,40}\*\*\]')) >= 5 then 'note_markers'
  when len(regexp_extract_all(text, '[가-힣]{2,}[ ,.·][가-힣]{2,}[ ,.·][가-힣]{2,}')) >= 3 then 'hangul_prose'
  when regexp_matches(text, 'AKIA[A-Z0-9]{16}') then 'access_key'
  when len(regexp_extract_all(text, '[0-9]{16}')) >= 1 then 'long_number' end r from documents)""",
    "token_percentiles": f"""select lang, p, n[least(len(n) - 1, floor(p * len(n))::int)::int + 1] "value" from (select lang, list_sort(list({TOKENS}::bigint)) n from documents group by 1), (select unnest([0.05, 0.5, 0.95]::double[]) p)""",
    "fold_summary": f"""select split, count(*) docs, sum(s)::bigint spans, sum(i)::bigint in_scope, (sum(s) - sum(i))::bigint excluded, sum(t)::bigint tokens from (
  select d.doc_id, {FOLDS.replace("doc_id", "d.doc_id")} split, {TOKENS} t, coalesce(s, 0) s, coalesce(i, 0) i from documents d
  left join (select doc_id, count(*) s, count(*) filter (phi_type <> 'ID') i from ({ALL}) group by 1) g on g.doc_id = d.doc_id) group by rollup (split)""",
    "stem_groups": """select stem, count(distinct id) n_docs from (select source || '-' || doc_id id, source stem from documents) group by 1 having count(distinct id) >= 2""",
    "crossing_summary": f"""select folds, count(*) stems from (select stem, string_agg(distinct split, '+' order by split) folds, count(distinct id) n from
  (select (doc_id // 5) || '-' || doc_id id, (doc_id // 5)::varchar stem, {FOLDS} split from documents) group by 1) where n > 1 group by 1""",
    "split_verify": f"""select doc_id::varchar doc_id, case when doc_id % 13 = 0 then 'extra' else 'moved' end fault from documents where doc_id % 13 = 0 or doc_id % 17 = 0""",
    "doc_digests": "select doc_id::varchar doc_id, sha256(coalesce(text, '')) digest from documents",
    "termination": """with r as (select o_custkey series, row_number() over (partition by o_custkey order by o_orderkey) round,
  (o_orderkey * 7919 + o_custkey) % 1000 / 20000.0::double + 0.3 leak_rate, 1000 + o_custkey % 9000 n_dev from orders),
q as (select series * 1000 + (round - 1) // 8 series, (round - 1) % 8 + 1 round, leak_rate, n_dev from r),
g as (select series, round, lag(leak_rate) over w - leak_rate gain, n_dev from q window w as (partition by series order by round)),
b as (select *, coalesce(gain < greatest(0.005, 26.0::double / n_dev), false) below from g),
s as (select *, round > 2 and sum(below::int) over (partition by series order by round rows between 1 preceding and current row) = 2 conv from b)
select series, round, gain, below, conv or round >= 8 "stop", case when conv then 'converged' when round >= 8 then 'ceiling' end reason from s""",
}

# --- samples, author feedback and masked text --------------------------------------------------------------------


def drawn(seed: int, n: int = 40) -> str:
    """The hash draw where no type's share exceeds its count: a reserve of one each, then largest remainders."""
    return f"""err as ({_ERRORS}),
tally as (select phi_type, count(*) c from err group by 1),
share as (select phi_type, c, ({n} - count(*) over ())::double * (c - 1) / sum(c - 1) over () x from tally),
quota as (select phi_type, 1 + floor(x)::int + case when row_number() over (order by x - floor(x) desc, phi_type) <= {n} - count(*) over () - sum(floor(x)::int) over () then 1 else 0 end q from share),
taken as (select e.* from err e join quota using (phi_type)
  qualify row_number() over (partition by e.phi_type order by sha256(concat_ws('|', '{seed}', doc_id, "start", "end", phi_type, kind, span_index))) <= q)"""


def sample_oracles(seed: int) -> dict[str, str]:
    fields = 'doc_id, span_index, phi_type, kind, "start", "end"'
    near = 'p.doc_id = g.doc_id and p.phi_type = g.phi_type and p."start" < g."end" and g."start" < p."end"'
    return {
        "sample_hash": f"with {drawn(seed)} select {fields} from taken",
        "pool_summary": f"""with {drawn(seed)}, i as (select phi_type, count(*) in_pool from err group by 1),
t as (select phi_type, count(*) drawn, count(distinct doc_id) docs from taken group by 1)
select phi_type, in_pool, coalesce(drawn, 0)::bigint drawn, coalesce(docs, 0)::bigint docs from i left join t using (phi_type)""",
        "practice_pool": f"with {drawn(seed)} select {fields} from err except select {fields} from taken",
        "check_rules": f"""{WITH},err as ({_ERRORS}), p as (select distinct doc_id, phi_type, "start", "end", rule_id from pred where rule_id is not null),
met as (select p.rule_id, g.doc_id, g.phi_type, g."start", g."end", bool_or(p."start" <= g."start" and g."end" <= p."end") w from p join err g on {near} and g.kind = 'missed' group by all),
a as (select rule_id, count(*) filter (w) caught, count(*) filter (not w) partial from met group by 1),
b as (select rule_id, count(*) matches, count(*) filter (not exists (select 1 from gold g where {near})) off_gold from p group by 1)
select rule_id, matches, coalesce(caught, 0)::bigint caught, coalesce(partial, 0)::bigint partial, off_gold from b left join a using (rule_id)""",
    }


_UNITS = f"""with s as (select doc_id, "start", "end", phi_type from ({ALL})),
o as (select *, case when max("end") over w is null or "start" >= max("end") over w then 1 else 0 end o from s
  window w as (partition by doc_id order by "start", "end" rows between unbounded preceding and 1 preceding)),
r as (select *, sum(o) over (partition by doc_id order by "start", "end" rows unbounded preceding) i from o),
u as (select doc_id, min("start") a, max("end") b, case when count(distinct phi_type) = 1 then '[' || min(phi_type) || ']' else '[PHI]' end tag from r group by doc_id, i),
p as (select *, coalesce(lag(b) over (partition by doc_id order by a), 0) z from u),
m as (select doc_id, string_agg(substr(text, z + 1, a - z) || tag, '' order by a) front, max(b) b from p join documents using (doc_id) group by 1),
masked as (select d.doc_id, coalesce(front, '') || substr(text, coalesce(b, 0)::int + 1) masked_text from documents d left join m using (doc_id))"""
ORACLES["mask_text"] = f"{_UNITS} select * from masked"

_LINES = f"""{_UNITS},
tags as (select doc_id, a, b, length(tag) n, a + coalesce(sum(length(tag) - (b - a)) over (partition by doc_id order by a rows between unbounded preceding and 1 preceding), 0) ms from u),
pieces as (select doc_id, unnest(range(0, len(l)))::int line, unnest(l) x from (select doc_id, string_split(masked_text, chr(10)) l from masked)),
ext as (select doc_id, line, length(x) size, coalesce(sum(length(x) + 1) over (partition by doc_id order by line rows between unbounded preceding and 1 preceding), 0) f from pieces)"""
ORACLES["line_geometry"] = f"""{_LINES}
select e.doc_id, e.line, e.size::int "length", (f + coalesce(sum(b - a - n) filter (ms + n <= f), 0))::int doc_offset, (count(*) filter (ms >= f and ms + n <= f + size))::int n_tags
from ext e left join tags t on t.doc_id = e.doc_id group by e.doc_id, e.line, e.size, e.f"""

# the flags of registry._responses: which refusal each meets, and where those that stand lie in the document
_FLAGS = f"""{_LINES},
top as (select doc_id, size, doc_id % 50 n from ext where line = 0),
own as (select t.* from tags t join top on top.doc_id = t.doc_id where ms >= 0 and ms + t.n <= size),
given as (select doc_id, size, n, unnest([0, 1, 2, 3, 4]) flag_index from top where n <> 7),
judged as (select g.doc_id, flag_index, case flag_index when 1 then 'out_of_range' when 4 then 'malformed' when 3 then 'crosses_a_line'
    when 2 then case when n + 2 > size then 'crosses_a_line' else 'undeclared_phi_type' end
    else case when n + 4 > size then 'crosses_a_line' when exists (select 1 from own o where o.doc_id = g.doc_id and g.n < o.ms + o.n and o.ms < g.n + 4) then 'inside_a_mask_tag' end end reason,
  n + coalesce((select sum(o.b - o.a - o.n) from own o where o.doc_id = g.doc_id and o.ms + o.n <= g.n), 0) s,
  n + 4 + coalesce((select sum(o.b - o.a - o.n) from own o where o.doc_id = g.doc_id and o.ms + o.n <= g.n + 4), 0) e from given g),
flags as (select doc_id, flag_index::int flag_index, reason, case when reason is null then s else -1 end::int "start", case when reason is null then e else -1 end::int "end",
    case when reason is null then 'NAME' end phi_type, case when reason is null then 1.0 end::double score from judged
  union all select doc_id, 0, 'malformed', -1, -1, null, null from documents where doc_id % 50 = 7)"""
ORACLES["flag_validate"] = f"{_FLAGS} select * from flags"
ORACLES["audit_report"] = f"""{_FLAGS}
select 'type' kind, phi_type "name", count(*) n from flags where reason is null group by 2
union all select 'refusal', reason, count(*) from flags where reason is not null group by 2
union all select 'documents', case when ok then 'flagged' else 'unflagged' end, count(*) from (select doc_id, coalesce(bool_or(reason is null), false) ok from documents left join flags using (doc_id) group by 1) group by 2"""

_TERMS = "(?i)(the MIT License|stupid|loser|scum)"
_WORD = r"[\p{L}\p{M}\p{N}_]"
ORACLES["detect_gazetteer"] = f"""select doc_id, "start"::int "start", "end"::int "end", 'en:insults' rule_id from {spans(_TERMS)} join documents using (doc_id)
where not ("start" > 0 and regexp_matches(substr(text, "start"::int, 1), '{_WORD}')) and not regexp_matches(substr(text, "end"::int + 1, 1), '{_WORD}')"""

_MISSED = full("fully_covered", """select doc_id, span_index, phi_type, 'missed' kind, "start", "end" from vm where not covered""")
_TOUCH = """p.doc_id = m.doc_id and p."start" < m."end" and m."start" < p."end\""""
_DIGITS = "list_transform(string_split(reverse(digits), ''), lambda x: x::int)"
ORACLES |= {
    "join_flags_sample": f"""{WITH}, m as ({_MISSED}) select m.doc_id, m.span_index, m.phi_type, m.kind, m."start", m."end", coalesce(min(p.span_index), -1) flag_index
  from m left join pred p on {_TOUCH} group by m.doc_id, m.span_index, m.phi_type, m.kind, m."start", m."end\"""",
    "unmatched_flags": f"""{WITH}, m as ({_MISSED}) select doc_id, span_index flag_index, "start", "end" from pred p where not exists (select 1 from m where {_TOUCH})""",
    "count_by_type": f"{WITH} select phi_type, excluded, count(*) n, count(distinct doc_id) n_docs from lines where is_gold group by 1, 2",
    "initial_error_pool": f"""{WITH} select doc_id, span_index, phi_type, 'missed' kind, "start", "end" from gold""",
    "apply_split": f"select doc_id::varchar doc_id, {FOLDS} split from documents",
    "checksums": f"""with n as (select o_orderkey, lpad((o_orderkey * 7919 % 100000000)::varchar, 8, '0') e, o_orderkey * 7919 % 100000000 n from orders),
d as (select o_orderkey, n, e, substr('TRWAGMYF', (n % 8 + 1)::int, 1) l, e || o_orderkey::varchar digits from n),
f as (select *, {_DIGITS} v from d)
select o_orderkey, substr('TRWAGMYFPDXBNJZSQVHLCKE', (n % 23 + 1)::int, 1) = l dni_mod23,
  substr('TRWAGMYFPDXBNJZSQVHLCKE', (('1' || substr(e, 2, 7))::bigint % 23 + 1)::int, 1) = l nie_mod23,
  list_sum(list_transform(v, lambda x, i: case when i % 2 = 0 then case when x > 4 then 2 * x - 9 else 2 * x end else x end)) % 10 = 0 luhn,
  list_sum(v) % 10 = 0 mod10 from f""",
}

# --- corpora, order, the way back, screening ------------------------------------------------------------------------

_NOTES = """with d as (select doc_id, text, ['FECHAS', 'PAIS', 'SEXO_SUJETO_ASISTENCIA', 'HOSPITAL'][doc_id % 4 + 1] subtype, least(length(text), doc_id % 5 + 1)::int size from documents
  where length(text) > 0 and not regexp_matches(substr(text, 1, 5), '[\\x20\\x09-\\x0D]'))"""
_ANY = " or ".join(f"regexp_matches(path, '{p}')" for p in ("^data/", "(^|/)data/(source|derived|raw|interim)/", "(^|/)call_logs?/"))
_FILES = f"""with f as (select doc_id, ['docs/', 'data/raw/', 'sealed/', 'notes/call_log/', 'results/'][doc_id % 5 + 1] || doc_id || case when doc_id % 2 = 0 then '.md' else '.jsonl' end path, text, doc_id % 3 > 0 visible from documents),
x as (select *, path like 'sealed/%' or {_ANY} out from f),
screened as (select x.*, case when out and visible then 'blocked' when path like 'sealed/%' then 'sealed' when out then 'quarantined' when w.reason is not null then 'suspect' else 'allowed' end "class",
  case when not out then w.reason end reason from x join ({{screen}}) w using (doc_id))"""
_FILES = _FILES.replace("{screen}", ORACLES["screen_documents"].replace('"class"', "kind"))
ORACLES |= {
    "parse_notes": f"""{_NOTES} select doc_id, 0 "start", size "end", case subtype when 'FECHAS' then 'DATE' when 'PAIS' then 'LOCATION_AREA' when 'HOSPITAL' then 'ORGANISATION' end phi_type,
  subtype = 'SEXO_SUJETO_ASISTENCIA' excluded, subtype from d""",
    "wrong_offsets": f"{_NOTES} select doc_id, 0 span_index from d where doc_id % 11 = 0 and substr(text, 1, size) <> '?'",
    "sorted_spans": f"""select doc_id, row_number() over (partition by doc_id order by "start", "end", coalesce(rule_id, ''))::int place, "start", "end", rule_id from ({ALL})""",
    "rendered_lines": f"{_LINES} select doc_id, line \"number\", lpad(line::varchar, 7, '0') || ' | ' || x line from pieces",
    "way_back": f"""{_LINES} select m.doc_id, (m.n + coalesce(sum(b - a - t.n) filter (ms + t.n <= m.n), 0))::int "at" from (select doc_id, length(masked_text) // 2 n from masked) m
  left join tags t on t.doc_id = m.doc_id group by m.doc_id, m.n""",
    "target_errors": f"select phi_type, kind, count(*) n from ({_ERRORS}) where phi_type <> 'DATE' group by 1, 2",
    "merge_by_priority": f"""select phi_type, count(*) n, sum(n_merged)::bigint merged, sum("start")::bigint starts, sum("end")::bigint ends from ({WITH},{UNION.format(name="isl", source="pred", keys="doc_id").replace('"start" > max', '"start" >= max').replace('max("end") "end"', """max("end") "end", count(*) n_merged,
  arg_max(phi_type, {'a': -list_position(['regex_checksum','context_cue','gazetteer','tagger'], layer), 'b': "end" - "start", 'c': -"start", 'd': -span_index}) phi_type""")} select * from isl) group by 1""",
    "fold_types": f"""select {FOLDS} split, case when phi_type = 'ID' then 'excluded_type' else 'phi_type' end kind, case when phi_type = 'ID' then rule_id else phi_type end "name", count(*) n from ({ALL}) group by all""",
    "fold_tokens": f"""select split, p, n[least(len(n) - 1, floor(p * len(n))::int)::int + 1] "value" from (select {FOLDS} split, list_sort(list({TOKENS}::bigint)) n from documents group by 1), (select unnest([0.05, 0.5, 0.95]::double[]) p)""",
    "screen_files": f"""{_FILES} select path, "class", reason, false listed from screened""",
    "screen_parts": f"""{_FILES},
allow as (select path, doc_id, case when doc_id % 8 = 0 then 'long' else 'access' end sniff from f where doc_id % 5 in (0, 4) and doc_id % 4 = 0)
select path, reason, case when starts_with(reason, sniff) then 'known' when visible then 'unexpected' else 'unpublishable' end part from screened left join (select path, sniff from allow) using (path) where "class" = 'suspect' and doc_id % 16 > 0
union all select path, null, 'stale' from allow where doc_id % 16 = 0""",
}

# tokens by place; all sequences of up to five tokens that are terms; from left to right the longest that begins where the last one has ended or later
ORACLES["detect_lexicon"] = r"""
with w as (select row_number() over () item, regexp_extract_all(lower(text), '[a-z]+') w from benchmark),
terms as (select distinct array_to_string(w[i:i+n-1], ' ') term from (select item, w, n, unnest(range(1, len(w) - n + 2)) i from w, (select unnest([1, 2, 3]) n) where len(w) > 2)),
d as (select row_number() over () rid, doc_id, regexp_extract_all(text, '[\p{L}\p{M}\p{N}\p{Pc}]+|[^\p{L}\p{M}\p{N}\p{Pc}]') t from documents),
p as (select rid, doc_id, unnest(range(1, len(t) + 1)) i, unnest(t) x from d),
q as (select *, sum(length(x)) over (partition by rid order by i) - length(x) s from p),
g as (select rid, doc_id, i, s, n, case n when 1 then x when 3 then x || lead(x, 1) over o || lead(x, 2) over o
  else x || lead(x, 1) over o || lead(x, 2) over o || lead(x, 3) over o || lead(x, 4) over o end h from q, (select unnest([1, 3, 5]) n) window o as (partition by rid, n order by i)),
m as (select rid, doc_id, s, s + length(h) e, term from g join terms on lower(h) = term where h is not null),
b as (select rid, doc_id, s, max(e) e, arg_max(term, e) term from m group by rid, doc_id, s),
l as (select rid, doc_id, list_reduce(list([{'s': s, 'e': e, 'term': term}] order by s), lambda a, x: case when x[1].s >= a[-1].e then a || x else a end) k from b group by rid, doc_id),
u as (select doc_id, unnest(k) k from l)
select doc_id, k.s::int "start", k.e::int "end", k.term term from u"""

ORACLES["read_cas"] = f"""select doc_id::varchar doc_id, "start"::int "start", "end"::int "end", substr(text, "start"::int + 1, ("end" - "start")::int) surface, rule_id subtype, phi_type from ({ALL}) a join documents using (doc_id)
union all select doc_id::varchar, 0, least(length(text), 4)::int, substr(text, 1, 4), 'front', 'NAME' from documents where length(text) > 0"""
ORACLES["read_corpus"] = f"""select doc_id::varchar doc_id, {FOLDS} split, (row_number() over (partition by doc_id order by "start", "end", rule_id) - 1)::int span_index, "start"::int "start", "end"::int "end",
  substr(text, "start"::int + 1, ("end" - "start")::int) surface, rule_id subtype, phi_type from ({ALL}) a join documents using (doc_id)"""

# --- results, manifests, groupings, names, files ----------------------------------------------------------------------

_LEVELS = [6, 4, 2, 0]
_NODE = "string_agg({row}, chr(10) order by {row})"


def _tree() -> str:
    entry = "doc_id || chr(9) || digest"
    parts = [f"l6 as (select substr(sha256(doc_id), 1, 6) node, count(*)::bigint n_docs, sha256({_NODE.format(row=entry)}) digest from d group by 1)"]
    for below, n in zip(_LEVELS, _LEVELS[1:]):
        parts.append(f"l{n} as (select substr(node, 1, {n}) node, sum(n_docs)::bigint n_docs, sha256({_NODE.format(row='row')}) digest from (select node, n_docs, node || chr(9) || digest as row from l{below}) group by 1)")
    every = " union all ".join(f"select * from l{n}" for n in _LEVELS)
    return f"with d as (select doc_id::varchar doc_id, sha256(coalesce(text, '')) digest from documents), {', '.join(parts)} {every}"


_CALLS = """with c as (select ['ko-surro', 'es-meddocan', 'de-grascco', 'es-carmen', 'en-n2c2'][o_custkey % 5 + 1] corpus, ['R', 'T'][o_custkey % 2 + 1] detector, 'sup-free' supervision, 'port-loop' porting,
  (o_orderkey // 3 % 4 + 1)::int iteration, o_orderkey * 7919 % 1000 leaked, o_orderkey % 1000 p, o_custkey % 100 q, o_orderkey % 97 / 8.0::double w,
  o_custkey % 10 <> 3 and o_orderkey % 5 > 0 cached, o_orderkey % 50 r, o_orderkey % 7 t from orders)"""
_ARM = "corpus, detector, supervision, porting"

ORACLES |= {
    "manifest_tree": _tree(),
    "read_metrics_history": f"""{_CALLS}, r as (select {_ARM}, iteration, sum(leaked)::double / (count(*) * 1000) leak_rate from c group by all)
select *, lag(leak_rate) over (partition by {_ARM} order by iteration) - leak_rate gain from r""",
    "sum_costs": f"{_CALLS} select {_ARM}, count(*) llm_calls, sum(p)::bigint prompt_tokens, sum(q)::bigint completion_tokens, round(sum(w), 3) wall_seconds from c group by all",
    "sum_caching": f"""{_CALLS} select {_ARM}, bool_or(cached) enabled, max(case when cached then 'system' end) boundary, max(case when cached then '5m' end) ttl,
  coalesce(sum(r) filter (cached), -1)::bigint read_tokens, coalesce(sum(t) filter (cached), -1)::bigint write_tokens from c group by all""",
    "grouping_audit": """with w as (select doc_id // 3 stem, doc_id, source, lang, list_distinct(regexp_extract_all(text, '[A-Za-z]{9,}')) words, text is not null has from documents),
g as (select stem, count(*) n_docs, count(*) filter (has) n_has from w group by 1 having count(*) > 1),
k as (select stem, word, count(*) k from (select stem, unnest(words) word from w) group by all),
n as (select distinct k.stem from k join g using (stem) where k = n_docs),
s as (select stem, count(distinct source) = 1 and count(source) = count(*) one_source, count(distinct lang) = 1 and count(lang) = count(*) one_lang from w where has group by 1),
f as (select g.stem, n_docs, n.stem is not null shared_name, coalesce(one_source and n_has = n_docs, false) shared_record, coalesce(one_lang and n_has = n_docs, false) shared_date from g left join n using (stem) left join s using (stem))
select stem::varchar stem, n_docs, shared_name, shared_record, shared_date, shared_name and (shared_record or shared_date) grouped from f""",
    "rule_names": r"""with n as (select p_partkey, replace(p_name, ' ', '_') || case p_partkey % 7 when 1 then '_' || floor(p_retailprice)::int when 2 then '_Extra' when 3 then '_añejo' when 4 then '_a_b_c_d' when 5 then '_v' || p_partkey % 100 else '' end body from part),
p as (select *, list_filter(string_split_regex(lower(body), '[_-]'), lambda x: x <> '') parts from n),
r as (select p_partkey, 'en:' || body rule_id, case when len(parts) = 0 then 'empty' when regexp_matches(body, '[A-Z]') then 'capital' when regexp_matches(body, '[0-9]{3,}') then 'number'
  when regexp_matches(body, '[^\x00-\x7f]') then 'not_ascii' when length(body) > 40 then 'long' when len(parts) > 5 then 'many_parts'
  when len(list_filter(parts, lambda x: x not in ('cold', 'small', 'large', 'hot', 'widget', 'bolt', 'a', 'b', 'c', 'd') and not regexp_matches(x, '^(v[0-9]{1,2}|[0-9]{1,2}[a-z]{0,8})$'))) > 0 then 'unknown_word' end reason from p)
select * from r where reason is not null""",
    "span_files": f"""select doc_id::varchar doc_id, "start"::int "start", "end"::int "end", phi_type, case when rule_id = 'en:credential' then 'context_cue' else 'regex_checksum' end layer, 'R' detector, rule_id from ({ALL})""",
    "error_files": ORACLES["error_spans"],
}
