"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, debruijn, decontam, gbt, iforest, imatch, jaccard, langid, lines, negatives, pii, ranked, secrets


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file lies; on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int, doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod n."""
    return F.crc32(F.col(doc_id).cast("string")) % n


def op1_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iforest.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP2_SQL = r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words),
classes as (select list_sort(s) as s, min(doc_id) as c, len(any_value(s)) as n from sets group by list_sort(s)),
token as (select c, n, unnest(s) as t from classes),
common as (select a.c as a, b.c as b, count(*) as k, any_value(a.n) as na, any_value(b.n) as nb from token a join token b on a.t = b.t and a.c < b.c group by a.c, b.c),
link as (select a, b from common where 100 * k >= 80 * (na + nb - k)),
both_ways as (select a, b from link union all select b, a from link),
reach as (select c, c as r from classes union select reach.c, both_ways.b from reach join both_ways on both_ways.a = reach.r),
root as (select c, min(r) as component_id from reach group by c)
select sets.doc_id, len(sets.s)::bigint as n_shingles, case when len(sets.s) = 0 then sets.doc_id else root.component_id end as component_id
from sets join classes on classes.s = list_sort(sets.s) join root on root.c = classes.c
"""


def op3_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_table(spark, sf_dir, "documents")))


def op4_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(_table(spark, sf_dir, "documents")))


def op5_hist_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = gbt.score(docs, gbt.fit(docs, _table(spark, sf_dir, "labels"), fold(3) != 1))
    return found.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove(_table(spark, sf_dir, "documents"), kept=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = r"""
with w as (
  select doc_id, row_number() over (partition by doc_id order by i) as i, word from (
    select doc_id, unnest(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+')) as word, generate_subscripts(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), 1) as i from documents) where word <> ''),
win as (select doc_id, i, word, string_agg(word, ' ') over (partition by doc_id order by i rows between current row and 12 following) as g, count(*) over (partition by doc_id order by i rows between current row and 12 following) as n from w),
first as (select g, min(doc_id) as source from win where n = 13 group by g),
hit as (select win.doc_id, win.i, win.word, coalesce(win.n = 13 and first.source < win.doc_id, false) as hit from win left join first on first.g = win.g),
gone as (select doc_id, i, word, bool_or(hit) over (partition by doc_id order by i rows between 12 preceding and current row) as gone from hit)
select d.doc_id, count(gone.i)::bigint as n_words, count_if(coalesce(gone.gone, false))::bigint as n_removed,
  sha256(coalesce(string_agg(gone.word, ' ' order by gone.i) filter (where not gone.gone), '')) as kept_sha256
from documents d left join gone on gone.doc_id = d.doc_id group by d.doc_id
"""


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return lines.remove(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_BARE = "trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
OP8_SQL = f"""
with pieces as (select doc_id, coalesce(source, '') as site, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
bad as (select {_BARE} as bare from pieces where {_BARE} <> '' group by 1 having count(distinct site) >= 10)
select doc_id, count_if({_BARE} <> '')::bigint as n_lines, count_if(bad.bare is not null)::bigint as n_removed,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where bad.bare is null), '')) as kept_sha256
from pieces left join bad on bad.bare = {_BARE} group by doc_id
"""


def op9_zstd_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    dictionaries = langid.train(docs, fold(4) != 2)
    return langid.identify(docs, dictionaries).select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(_table(spark, sf_dir, "documents"), tokenizer_path(), ids=False)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(_table(spark, sf_dir, "embeddings"))


OP11_SQL = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_dot_product(a.q, b.q)::bigint as score from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, id)::int as rank, id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, id) <= 10
"""


def op12_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with over 4096 terms of the lexicon have the sparsest level too, which OP12_SQL leaves out: such rows differ from it."""
    return imatch.fingerprints(_table(spark, sf_dir, "documents"))


_DIGIT = "substr(h, 2 * i + {}, 1)"
OP12_SQL = rf"""
with d as (select row_number() over (order by doc_id desc nulls last, coalesce(text, '')) as rn, doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n from documents),
nx as (select *, coalesce(lead(text) over (order by rn), first_value(text) over (order by rn)) as nxt from d),
t as (select rn, 0 as which, text from nx union all select rn, 1, left(text, (n - n // 3)::bigint) || left(nxt, (n // 3)::bigint) from nx),
w as (select rn, which, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> ''))) as term from t),
lex as (select term from w where which = 0 group by term having count(*) between 0.001::double * (select count(*) from d) and 0.1::double * (select count(*) from d)),
k as (select w.*, lex.term is not null as inside from w left join lex using (term)),
c as (select *, count_if(inside) over (partition by rn, which) as held, count(*) over (partition by rn, which) as everything from k),
chosen as (select rn, which, term, md5(term) as h, case when held >= 8 then held else everything end as n from c where inside or held < 8),
grid as (select i, k from (select unnest(range(16)) as i) cross join (select unnest(range(4)) as k)),
sig as (select rn, which, i, k, case when any_value(n) > 16 * pow(4, k + 1) then '++++' else substr(md5(string_agg(term, ' ' order by term)), 1, 4) end as s from chosen join grid
  on case k when 0 then {_DIGIT.format(1)} < '4' when 1 then {_DIGIT.format(1)} = '0' when 2 then {_DIGIT.format(1)} = '0' and {_DIGIT.format(2)} < '4' else {_DIGIT.format(1)} = '0' and {_DIGIT.format(2)} = '0' end group by rn, which, i, k),
crowd as (select rn, which, any_value(n) as n from chosen group by rn, which),
slot as (select t.rn, t.which, i, k, coalesce(s, case when coalesce(n, 0) > 16 * pow(4, k + 1) then '++++' else '----' end) as s from t cross join grid left join sig using (rn, which, i, k) left join crowd using (rn, which)),
fp as (select rn, which, string_agg(s, '' order by i, k) as f from slot group by rn, which),
pairs as (select rn, 'e' as kind, rn as a, 0 as wa, rn as b, 1 as wb from d union all select rn, 'n', rn, 0, case when rn = (select max(rn) from d) then 1 else rn + 1 end, 0 from d),
both_slots as (select p.rn, p.kind, x.k, x.s as s1, y.s as s2 from pairs p join slot x on x.rn = p.a and x.which = p.wa join slot y on y.rn = p.b and y.which = p.wb and y.i = x.i and y.k = x.k),
lev as (select rn, kind, k, count_if(s1 <> s2 or s1 not in ('----', '++++')) as used, count_if(s1 = s2 and s1 not in ('----', '++++')) as same from both_slots group by rn, kind, k),
best as (select rn, kind, arg_max(coalesce(same::double / nullif(used, 0), 0), case when used >= 8 then 1000 + k else used * 10 + k end) as share from lev group by rn, kind),
near as (select p.rn, p.kind, case when fa.f = fb.f then 1.0::double else best.share end as near from pairs p join fp fa on fa.rn = p.a and fa.which = p.wa join fp fb on fb.rn = p.b and fb.which = p.wb join best on best.rn = p.rn and best.kind = p.kind)
select d.doc_id, d.n as n_chars, sha256(t.text) as edited_sha256, f0.f as fingerprint, f1.f as edited_fingerprint, ne.near as near_edited, nn.near as near_next
from d join t on t.rn = d.rn and t.which = 1 join fp f0 on f0.rn = d.rn and f0.which = 0 join fp f1 on f1.rn = d.rn and f1.which = 1 join near ne on ne.rn = d.rn and ne.kind = 'e' join near nn on nn.rn = d.rn and nn.kind = 'n'
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
with t as (select doc_id, row_number() over () as rn, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
s as (select count(*)::bigint as nd, sum(len(w))::bigint as l from t where len(w) > 0),
tf as (select rn, term, count(*)::bigint as tf from (select rn, unnest(w) as term from t) group by rn, term),
df as (select term, count(*)::bigint as df from tf group by term),
i as (select distinct item_id, text from benchmark),
q as (select item_id, text, term, count(*)::bigint as repeats from (select item_id, text, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from i) group by all),
w as (select q.*, floor(1000 * ln((2 * nd + 2)::double / (2 * df + 1)::double))::bigint as w from q join df using (term), s),
m as (select rn, doc_id, 75 + (25 * len(w)::bigint * nd) // l as m from t, s where len(w) > 0),
sc as (select item_id, text, doc_id, rn, sum(repeats * w.w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score from w join tf using (term) join m using (rn) group by item_id, text, doc_id, rn)
select item_id, row_number() over (partition by item_id, text order by score desc, doc_id)::int as rank, doc_id, score from sc where score > 0 qualify rank <= 20
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_isolation_forest, op2_ngram_jaccard, op3_pii_bootstrap, op4_secret_ownership, op5_hist_gbt, op6_debruijn_dedup, op7_spaced_seeds, op8_line_spread, op9_zstd_language_id, op10_bpe, op11_hard_negatives, op12_imatch, op13_ranked_search)}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard": OP2_SQL, "op6_debruijn_dedup": OP6_SQL, "op8_line_spread": OP8_SQL, "op11_hard_negatives": OP11_SQL, "op12_imatch": OP12_SQL, "op13_ranked_search": OP13_SQL}
