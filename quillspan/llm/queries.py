"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import automaton, chunk_store, edit_prints, host_rules, infill, kneser, lengths, mixing, pieces, posting_lists, secrets, tiles, treaps
from quillspan.llm.store import new_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.jaccard_components(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.length_histogram(documents(spark, sf_dir)).withColumnRenamed("grp", "lang")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "token-store")
    chunk_store.write_store(documents(spark, sf_dir), root)
    return chunk_store.read_store(spark, root)


def op5_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = pieces.decode_documents(pieces.encode_documents(documents(spark, sf_dir), keep_text=True))
    return decoded.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size")).cast("long").alias("taken"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.find_secrets(documents(spark, sf_dir)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.quality_rules(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_prints.fingerprints(documents(spark, sf_dir))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.score(documents(spark, sf_dir))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treaps.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest_columns(infill.transform(documents(spark, sf_dir)))


def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_lists.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_jaccard_join,
        op3_token_counts,
        op4_token_store,
        op5_sampled_pieces,
        op6_mixing,
        op7_secret_scan,
        op8_quality_rules,
        op9_edit_fingerprints,
        op10_lm_score,
        op11_lexical_search,
        op12_fill_in_middle,
        op13_nearest_vectors,
    )
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op2_jaccard_join": rf"""
with recursive d as (select row_number() over () rid, doc_id,
    {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} w from documents),
long as (select rid, w, unnest(range(1, len(w) - 1)) i from d where len(w) > 2),
sh as (select distinct rid, array_to_string(w[i:i+2], ' ') s from long
  union all select rid, array_to_string(w, ' ') from d where len(w) in (1, 2)),
n as (select rid, count(*) n from sh group by rid),
met as (select a.rid x, b.rid y, count(*) c from sh a join sh b on a.s = b.s and a.rid < b.rid group by 1, 2),
link as (select x, y from met join n p on p.rid = x join n q on q.rid = y where 100 * c >= 90 * (p.n + q.n - c)),
edge as (select x, y from link union select y, x from link),
reach as (select x, y from edge union select r.x, e.y from reach r join edge e on r.y = e.x)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, least(d.doc_id, coalesce(min(o.doc_id), d.doc_id)) component_id
from d left join n using (rid) left join reach r on r.x = d.rid left join d o on o.rid = r.y group by d.rid, d.doc_id, n.n""",
    "op8_quality_rules": rf"""
with d as (select row_number() over () rid, doc_id, source, coalesce(text, '') t, {_WORDS} w from documents),
win as (select rid, unnest(range(1, len(w) - 3)) i, w from d where len(w) >= 5),
five as (select rid, i, array_to_string(w[i:i+4], ' ') g from win),
rep as (select rid, i from five qualify count(*) over (partition by rid, g) > 1),
covered as (select rid, count(distinct i + k) c from rep, (select unnest([0,1,2,3,4]) k) group by rid),
line as (select rid, unnest(string_split(t, chr(10))) l from d),
dup as (select rid, count(*) - count(distinct l) c from line where regexp_matches(l, '[^\x20\x09-\x0D]') group by rid),
s as (select d.rid, doc_id, source, len(w)::bigint n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
  coalesce(dup.c, 0)::bigint n_dup_lines, coalesce(covered.c, 0)::bigint n_repeat_words
  from d left join covered using (rid) left join dup using (rid)),
j as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from s),
h as (select source, count(*) n, count(*) filter (base_failed) f from j group by source),
p as (select sum(f) / sum(n) m, avg((f / n) * (f / n)) - avg(f / n) * avg(f / n) v from h),
k as (select m, case when v > 0 then least(1e6, greatest(1.0, m * (1 - m) / v - 1)) else 1e6 end z from p),
r as (select source, (f + m * z) / (n + z) rate from h, k)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (rate > 0.5) kept
from j join r on j.source is not distinct from r.source""",
    "op11_lexical_search": rf"""
with i as (select row_number() over () pos, item_id, list_distinct({_TERMS}) ts from benchmark),
d as (select row_number() over () rid, doc_id, {_TERMS} ts from documents),
s as (select (count(*) filter (len(ts) > 0))::bigint big_n, sum(len(ts))::bigint big_l from d),
p as (select rid, t, count(*)::bigint tf from (select rid, unnest(ts) t from d) group by rid, t),
f as (select t, count(*)::bigint df from p group by t),
w as (select t, floor(1000 * ln((2 * big_n + 2)::double / (2 * df + 1)))::bigint w from f, s),
m as (select rid, doc_id, 10 + (90 * len(ts)::bigint * big_n) // big_l m from d, s where big_l > 0),
x as (select pos, item_id, unnest(ts) t from i),
r as (select pos, item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score
  from x join w using (t) join p using (t) join m using (rid) group by pos, item_id, rid, doc_id)
select item_id, (row_number() over (partition by pos order by score desc, doc_id asc nulls last))::int rank, doc_id, score from r where score > 0
qualify rank <= 10""",
    "op12_fill_in_middle": """
with d as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') u,
    sha256('1:' || coalesce(cast(doc_id as varchar), '')) h from documents),
g as (select *, len(u)::bigint n, ('0x' || h[1:8])::bigint h1, ('0x' || h[9:16])::bigint h2, ('0x' || h[17:24])::bigint h3, ('0x' || h[25:32])::bigint h4 from d),
f as (select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
    when h4 % 100 < 20 then 'spm' else 'psm' end form from g),
p as (select *, array_to_string(u[1:a], '') pre, array_to_string(u[a+1:b], '') mid, array_to_string(u[b+1:n], '') suf from f)
select doc_id, n, form, case when form <> 'plain' then length(pre)::bigint end prefix_chars, case when form <> 'plain' then length(mid)::bigint end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) output_sha256,
  sha256(t) restored_sha256
from p""",
}
