"""Registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpaudit.llm import (
    brown_lm, jaccard, langid, mixing, negatives, packing, pages, passages, pii, quality, sharding, tries, vectors,
)
from corpaudit.llm.common import fold_mod, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)


@query
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(fold_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    filters = langid.train(docs.filter(~held_out).select("text", "lang"))
    found = langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), filters)
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query
def op10_class_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold_mod(F.col("doc_id"), 10) == 0, F.lit(False))
    scored = brown_lm.score_by_classes(docs, docs.filter(~held_out))
    columns = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    return scored.select("doc_id", held_out.alias("held_out"), *columns)


@query
def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, folder, "documents").select("doc_id", "text")))


@query
def op5_html_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract(table(spark, folder, "pages").select("page_id", "url", "html"))


@query
def op3_embedding_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings").select("vec_id", "embedding"), 0.95)


#: Target weights of the mix, by name of the node; nodes without one weigh 1.
DOMAIN_WEIGHTS = {"web": 5, "books": 3, "forum": 2}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2}
SOURCE_WEIGHTS = {"src0": 2}
MIX_SEED, MIX_EPOCHS = 7, 2
DOMAIN = "case try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 3 when 1 then 'books' when 2 then 'forum' else 'web' end"


@query
def op4_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """A mix as large as the corpus: scarce leaves repeat, and their shortages move up the tree."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source", F.expr(DOMAIN).alias("domain"))
    weights = (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS)
    chosen = mixing.mixed(docs, ("domain", "lang", "source"), weights, 1.0, MIX_EPOCHS, MIX_SEED)
    return chosen.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch", "taken")


def _case(column: str, weights: dict[str, int]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in weights.items()) + " else 1 end"


def _fill_sql(out: str, nodes: str, parents: str, name: str) -> str:
    by = f"partition by {parents}" if parents else ""
    order = f"order by supply::double / weight, {name}"
    return f"""
{out}_marked as (
  select *, total - coalesce(sum(supply) over ({by} {order} rows between unbounded preceding and 1 preceding), 0) as left_over,
    sum(weight) over ({by} {order} rows between current row and unbounded following) as rest_weight,
    row_number() over ({by} {order}) as place
  from {nodes}),
{out}_level as (
  select *, min(case when left_over::hugeint * weight <= supply::hugeint * rest_weight then place end) over ({by}) as turn
  from {out}_marked),
{out} as (
  select *, coalesce(least(supply, (max(case when place = turn then left_over end) over ({by}))::hugeint * weight
    // max(case when place = turn then rest_weight end) over ({by})), supply)::bigint as budget
  from {out}_level)"""


ORACLES["op4_source_mixing"] = f"""
with sized as (
  select doc_id, coalesce(lang, '(none)') as k_lang, coalesce(source, '(none)') as k_source, lang, source,
    case try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 3 when 1 then 'books' when 2 then 'forum' else 'web' end as domain,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as n_tokens
  from documents),
leaves as (
  select domain, k_lang, k_source, sum(n_tokens)::bigint as tokens, (sum(n_tokens) * {MIX_EPOCHS})::bigint as supply
  from sized group by all),
n1 as (
  select domain, sum(supply)::bigint as supply, {_case("domain", DOMAIN_WEIGHTS)} as weight,
    (select sum(n_tokens) from sized)::bigint as total
  from leaves group by domain),
{_fill_sql("b1", "n1", "", "domain")},
n2 as (
  select l.domain, k_lang, sum(l.supply)::bigint as supply, {_case("k_lang", LANG_WEIGHTS)} as weight, any_value(b1.budget) as total
  from leaves l join b1 on l.domain = b1.domain group by l.domain, k_lang),
{_fill_sql("b2", "n2", "domain", "k_lang")},
n3 as (
  select l.domain, l.k_lang, k_source, l.tokens, l.supply, {_case("k_source", SOURCE_WEIGHTS)} as weight, b2.budget as total
  from leaves l join b2 on l.domain = b2.domain and l.k_lang = b2.k_lang),
{_fill_sql("b3", "n3", "domain, k_lang", "k_source")},
targets as (select *, budget // tokens as whole, budget % tokens as rest from b3 where tokens > 0),
joined as (
  select s.*, t.whole, t.rest, md5('{MIX_SEED}:' || t.whole || ':' || coalesce(s.doc_id::varchar, '')) as key
  from sized s join targets t using (domain, k_lang, k_source) where s.n_tokens > 0),
placed as (
  select *, coalesce(sum(n_tokens) over (partition by domain, k_lang, k_source order by key, doc_id
    rows between unbounded preceding and 1 preceding), 0) as before from joined)
select doc_id, domain, lang, source, n_tokens, epoch::int as epoch, n_tokens as taken
from joined, unnest(range(whole)) as e(epoch)
union all
select doc_id, domain, lang, source, n_tokens, whole::int, least(n_tokens, rest - before)::bigint from placed where before < rest
"""


@query
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.rules(table(spark, folder, "documents").select("doc_id", "text", "lang"))
    return judged.drop("class_distance", "word_distance")


_SQL_CLASSES = {"spaces": r"[\x20\x09-\x0D]", "symbols": "[#*$%&|<>]", "capitals": "[A-Z]", "digits": "[0-9]", "wide": r"[^\x00-\x7F]"}
_COUNTED = ", ".join(f"len(regexp_extract_all(t, '{p}')) as c_{n}" for n, p in _SQL_CLASSES.items())
_BOTH = "sum(case when {p} > 0 then {p} * log2(2 * {p} / ({p} + {q})) else 0 end + case when {q} > 0 then {q} * log2(2 * {q} / ({p} + {q})) else 0 end) / 2"
_DIVERGED = "sqrt(greatest(" + _BOTH.format(p="p", q="q") + ", 0))"
ORACLES["op8_quality_rules"] = f"""
with base as (
  select row_number() over () as row, doc_id, coalesce(lang, '(none)') as lang, text is not null as present, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
measured as (select *, len(w) as n_words, length(t) as size, {_COUNTED} from base),
ws as (select row, lang, n_words, unnest(w) as word, unnest(range(1, n_words + 1)) as pos from measured),
windows as (
  select row, i as pos, w[i:i + 7] as win from measured, unnest(range(1, n_words - 6)) as r(i)),
twice as (select row, pos from windows qualify count(*) over (partition by row, win) > 1),
repeats as (select row, count(distinct pos + k)::bigint as n_repeat_words from twice, range(8) as r(k) group by row),
lines as (
  select row, count(*) - count(distinct line) as n_dup_lines
  from (select row, unnest(string_split(t, chr(10))) as line from measured)
  where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by row),
counted as (select lang, word, count(*) as n from ws group by lang, word),
ranked as (select *, row_number() over (partition by lang order by n desc, word) as k from counted),
refs as (
  select m.lang, sum(n_words) as ref_words, sum(size) as ref_size, {", ".join(f"sum(c_{n}) as r_{n}" for n in _SQL_CLASSES)}
  from measured m where present group by m.lang),
class_shares as (
  select row, unnest([{", ".join(f"c_{n} / greatest(size, 1)" for n in _SQL_CLASSES)},
    (size - {" - ".join(f"c_{n}" for n in _SQL_CLASSES)}) / greatest(size, 1)]) as p,
    unnest([{", ".join(f"r_{n} / greatest(ref_size, 1)" for n in _SQL_CLASSES)},
    (ref_size - {" - ".join(f"r_{n}" for n in _SQL_CLASSES)}) / greatest(ref_size, 1)]) as q
  from measured m join refs using (lang) where n_words >= 50 and ref_words >= 1000),
by_class as (select row, {_DIVERGED} as far from class_shares group by row),
hits as (
  select m.row, r.k, count(ws.pos) / any_value(m.n_words) as p, any_value(r.n) / any_value(refs.ref_words) as q
  from measured m join refs using (lang) join ranked r on r.lang = m.lang and r.k <= 16
    left join ws on ws.row = m.row and ws.word = r.word
  where m.n_words >= 50 and refs.ref_words >= 1000 group by m.row, r.k),
rests as (select row, 0 as k, 1 - sum(p) as p, 1 - sum(q) as q from hits group by row),
by_word as (select row, {_DIVERGED} as far from (select * from hits union all select * from rests) group by row),
judged as (
  select m.*, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    coalesce(c.far, 0) as class_far, coalesce(v.far, 0) as word_far
  from measured m left join lines using (row) left join repeats using (row)
    left join by_class c using (row) left join by_word v using (row))
select doc_id, n_words::bigint as n_words, (size - c_spaces)::bigint as word_chars, c_symbols::bigint as n_symbols,
  n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and class_far <= 0.25 and word_far <= 0.42 as kept
from judged
"""


@query
def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.groups(table(spark, folder, "documents").select("doc_id", "text"), 4, 85, 100)


@query
def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passages.without_repeats(table(spark, folder, "documents").select("doc_id", "text"), 400)


#: Shards of the corpus, and bytes that a document takes beside its text.
SHARDS, OVERHEAD = 40, 16


@query
def op11_balanced_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of equal texts are neighbours; the law is `rows`: shards differ by one row at most."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    measured = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.when(F.col("text").isNotNull(), F.array(F.xxhash64("text"))).alias("links"),
    )
    placed = sharding.sharded(measured, F.col("links"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(
        "vec_id", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)").alias("label"), "embedding"
    )
    return negatives.mined(rows, F.col("vec_id") % 100 == 0, 256, 5, 5, 80, 100, 100)


ORACLES["op12_hard_negatives"] = """
with usable as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, list_inner_product(a.v, r.v)::bigint as score
  from usable a, usable r where a.vec_id % 100 = 0),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored
  where same and vec_id <> anchor_id
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
ranked as (
  select anchor_id, positive_id, s.vec_id as negative_id, positive_score, s.score as negative_score,
    row_number() over (partition by anchor_id, positive_id order by s.score desc, s.vec_id) as rank
  from positives p join scored s using (anchor_id)
  where not s.same and 80 * positive_score <= 100 * s.score and s.score <= positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from ranked where rank <= 5
"""


@query
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return tries.trie(tries.with_shared_heads(tries.conversations(rows)))


#: crc32 of a decimal, bit by bit: the byte comes in at every eighth step.
_CRC32 = """xor(list_reduce([4294967295] || flatten(list_transform(range(1, length(conv_id::varchar) + 1),
    lambda i: [ascii(substr(conv_id::varchar, i, 1))::bigint, 0, 0, 0, 0, 0, 0, 0])),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"""
ORACLES["op13_prefix_trie"] = f"""
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as place
  from conversations where conv_id is not null),
convs as (select conv_id, {_CRC32} % 4 as h from (select distinct conv_id from turns)),
joined as (
  select c.conv_id, t.place, t.role, t.text from convs c join turns t on t.conv_id = c.conv_id - c.conv_id % 20 and t.place <= h
  union all
  select c.conv_id, 1000000 + t.place, t.role, t.text from convs c join turns t on t.conv_id = c.conv_id and t.place > h),
rebuilt as (
  select *, row_number() over (partition by conv_id order by place) as depth from joined),
prefixes as (
  select conv_id, depth, text, string_agg(md5(role || chr(1) || text), ',') over (partition by conv_id order by depth) as path
  from rebuilt
  union all select conv_id, 0, '', '' from convs),
ends as (select conv_id, max(depth) as last from prefixes group by conv_id),
nodes as (
  select path, min(p.conv_id) as conv_id, any_value(depth) as depth, count(*) as n_convs, any_value(text) as text,
    coalesce(string_agg(case when last = depth then p.conv_id::varchar end, ',' order by p.conv_id), '') as ended
  from prefixes p join ends e on e.conv_id = p.conv_id group by path),
up as (
  select n.path, q.path as above, q.depth = n.depth - 1 as parent
  from nodes n join prefixes q on q.conv_id = n.conv_id and q.depth <= n.depth),
childs as (select above as path, count(*) as n_children from up where parent group by above),
named as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join childs using (path)),
below as (
  select above as path, sum(case when n_children = 0 then 1 else 0 end) as n_leaves,
    sum((n_convs - 1) * len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) as saved
  from up join named using (path) group by above)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs::bigint as n_convs,
  n.n_children::bigint as n_children, n_leaves::bigint as n_leaves, saved::bigint as saved_tokens, sha256(n.ended) as ends_sha256
from named n join below using (path) left join up u on u.path = n.path and u.parent
  left join nodes p on p.path = u.above
"""
