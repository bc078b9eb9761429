"""One query for each operator of this subpackage, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_search, chat_format, collocations, lm_score, piece_coding, simhash, source_audit, source_mix, substring_dedup, suffix_dedup, token_records, topk_search, toxicity
from .common import table

TRICKY = r"\### Assistant: </turn> ok"


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_records.token_records(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_coding.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(table(spark, sf_dir, "documents"))


def op6_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), passages=suffix_dedup.WORDS)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.col("n_passage").alias("n_passage_bytes"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turn = F.col("id")
    tricky = spark.range(2).select(F.lit(-7).alias("conv_id"), turn.alias("turn"), F.when(turn == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    c = c.unionByName(tricky)
    return chat_format.digests(chat_format.written(c))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_records": op1_token_records,
    "op2_topk_search": op2_topk_search,
    "op3_toxicity": op3_toxicity,
    "op5_piece_coding": op5_piece_coding,
    "op7_lm_score": op7_lm_score,
    "op6_ann_search": op6_ann_search,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op8_chat_format": op8_chat_format,
    "op9_simhash": op9_simhash,
    "op10_source_mix": op10_source_mix,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_collocations": op12_collocations,
    "op13_source_audit": op13_source_audit,
}

_OP2 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score from v q, v c where q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from p
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""

_OP8 = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '\### Assistant: </turn> ok'
           union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c'))
              + length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t')) + 14 as n from c),
s as (select *, sum(n) over (partition by conv_id order by turn, role, text rows unbounded preceding) as upto from e),
g as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
             coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as loss,
             coalesce(sum(upto) filter (role = 'assistant'), 0) as ex, coalesce(max(upto) filter (role = 'assistant'), 0) as longest, max(upto) as total
      from s group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256,
       (ex + case when total > longest then total else 0 end)::bigint as formatted_chars from g
"""

_OP10 = """
with d as (select *, coalesce(source, '') as src, md5(coalesce(text, '')) as h from documents),
s as (select src, sum(greatest(length(coalesce(text, '')), 1))::bigint as size from d group by src),
t as (select sum(pow(size, 0.7)) as shares, sum(size)::double as chars from s),
r as (select src, pow(size, 0.7) * (chars / shares) / size as mean from s, t),
w as (select src, mean / greatest(ceil(mean / 32.0), 1) as m, greatest(ceil(mean / 32.0), 1)::int as draws from r),
cdf as (select src, 0 as k, exp(-m) as c from w union all
        select src, k::int, (exp(-m) * list_sum([list_product([m / i for i in range(1, j + 1)]) for j in range(1, k + 1)]) + exp(-m)) from w, range(1, 120) as q(k)),
u as (select doc_id, d.src, h, i, ('0x' || substr(md5(concat_ws('|', '17', doc_id::varchar, d.src, h, i::varchar)), 1, 13))::bigint / 4503599627370496.0 as u
      from d join w on d.src = w.src, range(0, draws) as q(i)),
n as (select u.doc_id, u.src, u.h, u.i, count(*) filter (cdf.c <= u.u) as n from u join cdf using (src) group by all),
m as (select doc_id, src, h, sum(n)::int as n_mix from n group by all)
select d.doc_id, d.text, d.lang, d.source, d.n_chars, n_mix, c::int as copy_mix,
       md5(concat_ws('|', '17s', d.doc_id::varchar, d.h, c::varchar)) as order_mix
from d join m on d.doc_id = m.doc_id and d.src = m.src and d.h = m.h, range(1, n_mix + 1) as q(c)
"""

_OP11 = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
k as (select rid, doc_id, i, array_to_string(ws[i:i + 12], ' ') as seq from (select rid, doc_id, ws, unnest(range(1, len(ws) - 11)) as i from d where len(ws) >= 13)),
m as (select seq, min(doc_id) as lo from k group by seq),
g as (select distinct rid, k.i + j.j as i from k join m using (seq), range(13) as j(j) where doc_id > lo),
w as (select rid, unnest(ws) as word, generate_subscripts(ws, 1) as i from d),
r as (select w.rid, count(g.i) as n_removed, string_agg(word, ' ' order by w.i) filter (g.i is null) as kept from w left join g on w.rid = g.rid and w.i = g.i group by w.rid)
select doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join r using (rid)
"""

_OP12 = r"""
with t as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from t),
n as (select lang, sum(len(ws))::hugeint as n from w group by lang),
g as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, range(1, 6) as q(k) where len(ws) >= k)),
f as (select lang, k, phrase, count(*)::hugeint as a from g group by all),
o as (select *, string_split(phrase, ' ') as ws from f where k >= 2 and a >= 100),
s as (select distinct o.lang, array_to_string(ws[i:j], ' ') as inner_, o.a as longer from o, range(1, 6) as p(i), range(1, 6) as q(j) where j > i and j <= k and j - i + 1 < k),
gone as (select distinct f.lang, f.phrase from s join f on f.lang = s.lang and f.phrase = s.inner_ where 100 * s.longer >= 100 * f.a),
c as (select o.lang, o.phrase, o.a, l.a as l, r.a as r, n.n, c, (1000 * o.a * n.n) // (l.a * r.a) as score
      from o join range(1, 5) as q(c) on c < o.k join n on n.lang = o.lang
      join f l on l.lang = o.lang and l.phrase = array_to_string(ws[1:c], ' ') join f r on r.lang = o.lang and r.phrase = array_to_string(ws[c + 1:], ' ')),
b as (select * from c anti join gone using (lang, phrase) qualify row_number() over (partition by c.lang, c.phrase order by score, c) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase)::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from b qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000
"""

_OP13 = r"""
with d as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
w as (select rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term from w group by lang, term having count(distinct rid) >= 10),
c as (select lang, source, term, count(*)::hugeint as n from w join k using (lang, term) group by all),
g as (select distinct lang, source from d),
v as (select lang, count(*)::hugeint as v from k group by lang),
s as (select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as total, coalesce(any_value(v.v), 0)::hugeint as v from g left join c on g.lang = c.lang and g.source = c.source left join v on v.lang = g.lang group by all),
p as (select s.lang, s.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (s.total + 2 * s.v) as p
      from s join k on k.lang = s.lang left join c on c.lang = s.lang and c.source = s.source and c.term = k.term),
l as (select lang, term, 1 + (1000000000 * (n + 2)) // (total + 2 * v) as q
      from (select lang, term, sum(n) as n from c group by all) join (select lang, sum(total) as total, any_value(v) as v from s group by lang) using (lang)),
f as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
x as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value from s a join s b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
      union all select p.lang, p.source, 'term', p.term, ((p - q) * (p - q)) // (p + q) from p join l using (lang, term) where n > 0 and p > q),
r as (select lang, source, part, item, value::bigint as value, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from x)
select * from r where part = 'pair' or rank <= 10
"""

ORACLE_SQL = {"op13_source_audit": _OP13, "op12_collocations": _OP12, "op11_substring_dedup": _OP11, "op2_topk_search": _OP2, "op8_chat_format": _OP8, "op10_source_mix": _OP10}
