"""Record merging, array and matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from featherloom.catalog.common import h27, r
from featherloom.catalog.registry import query
from featherloom.catalog.text import WORD_TFIDF, tok
from featherloom.functions import arrays, textrules as tr
from featherloom.functions.hashing import key_hash
from featherloom.operators import match, parts, pivots, postings, records, textfeat, vectors
from featherloom.session import spread


def _event_rows(t):
    kind = F.when(F.col("event_type").isin("error", "signup"), "EMR").otherwise("LIS")
    return t.events.select(
        F.concat_ws("+", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("key"), kind.alias("kind"),
        F.when(kind == "LIS", F.col("event_type")).alias("category"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("item"), F.col("value").cast("string").alias("value"), "event_id")


EVENT_ROWS = """event_rows as (select user_id::VARCHAR || '+' || strftime(ts, '%Y%m%d') as key,
    case when event_type in ('error', 'signup') then 'EMR' else 'LIS' end as kind, case when event_type in ('error', 'signup') then '' else event_type end as category,
    'k' || (props::JSON ->> 'k') as item, value, event_id from events),
  lasts as (select key, kind, category, item, arg_max(value, event_id)::VARCHAR as value from event_rows group by all)"""
NESTED = f"""{EVENT_ROWS}, nested as (select key, kind, category, string_agg(item || '=' || value, ',' order by item) as items from lasts group by all)"""


def _flat(m):
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def _nested(t):
    return records.nested_records(_event_rows(t), "key", "kind", "category", "item", "value", F.col("event_id"))


@query("agg_10_nested_records", f"with {NESTED} select key, kind, category, items from nested")
def _(t):
    return _nested(t).withColumn("items", _flat("items"))


@query("jon_1_admissions_left_join", f"""with {NESTED}, adm as (select event_id, user_id::VARCHAR || '+' || strftime(ts + to_days((event_id % 4)::INTEGER), '%Y%m%d') as key from events)
select event_id, key, kind, category, items from adm left join nested using (key)""")
def _(t):
    # every event opens an admission up to three days later, so that some have no records
    day = F.date_format(F.col("ts") + F.make_dt_interval((F.col("event_id") % 4).cast("int")), "yyyyMMdd")
    adm = t.events.select("event_id", F.concat_ws("+", F.col("user_id").cast("string"), day).alias("key"))
    return records.left_join(adm, _nested(t), ["key"]).withColumn("items", _flat("items"))


@query("agg_11_nested_by_date", """
select o_custkey, strftime(o_orderdate, '%Y%m%d') as d, string_agg(o_orderkey::VARCHAR || '=' || o_orderstatus, ',' order by o_orderkey::VARCHAR) as cases from orders group by all""")
def _(t):
    x = t.orders.select("o_custkey", F.date_format("o_orderdate", "yyyyMMdd").alias("d"), F.col("o_orderkey").cast("string").alias("case"), "o_orderstatus")
    return records.nested_by_date(x, "o_custkey", "d", "case", "o_orderstatus", F.col("case")).withColumn("cases", _flat("cases"))


@query("agg_12_totals_report", """
with b as (select c_custkey::VARCHAR as name, c_acctbal, c_nationkey::DOUBLE as c_nationkey from customer),
x as (select * from b union all select 'TOTAL', sum(c_acctbal), sum(c_nationkey) from b union all select 'AVERAGE', round(avg(c_acctbal), 2), round(avg(c_nationkey), 2) from b)
select name, round(c_acctbal, 2) as c_acctbal, c_nationkey, round(c_acctbal + c_nationkey, 2) as total from x""")
def _(t):
    return records.totals_report(t.customer, "c_custkey", ["c_acctbal", "c_nationkey"]).withColumns(
        {"c_acctbal": r("c_acctbal", 2), "total": r("total", 2)})


@query("agg_18_first_non_empty", """
select conv_id, role, arg_min(text, turn) as text from conversations where trim(text) <> '' group by all""")
def _(t):
    return records.first_non_empty(t.conversations, ["conv_id", "role"], "text", "turn")


@query("agg_19_pivot_sections", """
select conv_id, coalesce(string_agg(text, '' order by turn) filter (role = 'system'), '') as role_system,
       coalesce(string_agg(text, '' order by turn) filter (role = 'user'), '') as role_user,
       coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '') as role_assistant from conversations group by conv_id""")
def _(t):
    return records.pivot_sections(t.conversations, "conv_id", "role", "turn", "text", ["system", "user", "assistant"])


@query("win_8_control_break", "select user_id, event_type, count(*) as rows, round(sum(value), 4) as total, min(value) as low, max(value) as high from events group by all")
def _(t):
    return records.control_break(t.events, ["user_id", "event_type"], "value")


@query("jon_12_lookup_or_default", """
with lines as (select c_custkey, case when c_acctbal < 0 then c_custkey::VARCHAR || ',x,' || c_mktsegment else c_custkey::VARCHAR || ',x,y,' || c_mktsegment end as line from customer),
keyed as (select string_split(line, ',')[1] as k, string_split(line, ',')[4] as seg from lines where len(string_split(line, ',')) = 4)
select o_orderkey, coalesce(seg, 'not valid') as segment from orders left join keyed on k = o_custkey::VARCHAR""")
def _(t):
    key = F.col("c_custkey").cast("string")
    lines = t.customer.select(F.when(F.col("c_acctbal") < 0, F.concat_ws(",", key, F.lit("x"), "c_mktsegment"))
                              .otherwise(F.concat_ws(",", key, F.lit("x"), F.lit("y"), "c_mktsegment")).alias("line"))
    table = records.parse_key_lines(lines, "line", "k", "segment")
    x = t.orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("k"))
    return records.lookup_or_default(x, "k", table, "segment", "not valid").select("o_orderkey", "segment")


@query("map_1_drop_and_rename_keys", """
with c as (select user_id, event_type, count(*) as n from events where event_type <> 'error' group by all)
select user_id, string_agg(upper(event_type) || '=' || n::VARCHAR, ',' order by event_type) as counts from c group by user_id""")
def _(t):
    counts = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("string").alias("n"))
    made = counts.groupBy("user_id").agg(records.sorted_map("event_type", "n").alias("m"))
    out = made.select("user_id", records.rename_map_keys(records.drop_map_keys("m", ["error"]), F.upper).alias("m"))
    return out.where(F.size("m") > 0).select("user_id", _flat("m").alias("counts"))


@query("jsn_1_parse_and_write", """
select event_id, (props::JSON ->> 'k')::BIGINT as k, '{"k":' || ((props::JSON ->> 'k')::BIGINT + 1)::VARCHAR || ',"type":"' || event_type || '"}' as json from events""")
def _(t):
    x = t.events.select("event_id", "event_type", F.from_json("props", "k bigint").alias("p"))
    return x.select("event_id", F.col("p.k").alias("k"), F.to_json(F.struct((F.col("p.k") + 1).alias("k"), F.col("event_type").alias("type"))).alias("json"))


# -- arrays ------------------------------------------------------------------------------------

def _text(arr, places: int = 5):
    """An array as text of rounded integers, the same on both sides."""
    return F.array_join(F.transform(arr, lambda x: F.round(x.cast("double") * 10 ** places).cast("long").cast("string")), " ")


def text_sql(arr: str, places: int = 5) -> str:
    return f"array_to_string(list_transform({arr}, lambda x: round(x::DOUBLE * {10 ** places})::BIGINT::VARCHAR), ' ')"


@query("arr_1_fit_length", f"""
select vec_id, {text_sql('list_concat(embedding, list_transform(range(6), lambda i: 0.0::FLOAT))')} as padded, {text_sql('embedding[15:]')} as cut from embeddings""")
def _(t):
    return t.embeddings.select("vec_id", _text(arrays.fit_length("embedding", 70, F.lit(0.0).cast("float"))).alias("padded"),
                               _text(arrays.fit_length("embedding", 50, F.lit(0.0).cast("float"), "pre")).alias("cut"))


@query("arr_2_min_max", f"""
select vec_id, {text_sql("list_transform(embedding, lambda y: 2 * (y::DOUBLE - list_min(embedding)::DOUBLE) / (list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE) - 1)")} as scaled from embeddings""")
def _(t):
    return t.embeddings.select("vec_id", _text(arrays.min_max_signed("embedding")).alias("scaled"))


@query("arr_3_circular_shift", f"""
with k as (select vec_id, embedding as e, ({h27('vec_id::VARCHAR')} % 64)::INTEGER as k from embeddings)
select vec_id, k, {text_sql('list_concat(e[65 - k:], e[:64 - k])')} as shifted from k""")
def _(t):
    x = t.embeddings.withColumn("k", (key_hash("vec_id") % 64).cast("int"))
    return x.select("vec_id", "k", _text(arrays.circular_shift("embedding", F.col("k"))).alias("shifted"))


@query("arr_4_scaled_sum", """
with n as (select label, arg_min(embedding, vec_id) as noise from embeddings group by label),
x as (select vec_id, unnest(embedding) as a, unnest(noise) as b, unnest(range(1, 65)) as i from embeddings join n using (label))
select vec_id, round(sum((a::DOUBLE * 0.9::DOUBLE + b::DOUBLE * 0.1::DOUBLE) * i), 5) + 0.0 as checksum from x group by vec_id""")
def _(t):
    noise = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("noise"))
    mixed = t.embeddings.join(noise, "label").select("vec_id", arrays.scaled_sum("embedding", "noise", 0.9, 0.1).alias("m"))
    return mixed.select("vec_id", r(arrays.total(F.transform("m", lambda x, i: x * (i + 1))), 5).alias("checksum"))


@query("arr_5_silent", "select vec_id, abs(list_sum(list_transform(embedding, lambda x: case when label = 3 then 0 else x::DOUBLE end))) <= 1e-5 as silent from embeddings")
def _(t):
    x = t.embeddings.select("vec_id", F.transform("embedding", lambda x: F.when(F.col("label") == 3, F.lit(0.0)).otherwise(x.cast("double"))).alias("e"))
    return x.select("vec_id", arrays.is_silent("e").alias("silent"))


@query("arr_6_standardise", """
with c as (select vec_id, unnest(embedding)::DOUBLE as x, unnest(range(64))::INTEGER as pos from embeddings)
select vec_id, pos, round((x - avg(x) over (partition by pos)) / stddev_pop(x) over (partition by pos), 5) + 0.0 as z from c""")
def _(t):
    return vectors.standardise_positions(t.embeddings, "vec_id", "embedding").withColumn("z", r("z", 5))


@query("arr_7_k_largest", f"select vec_id, {text_sql('list_reverse_sort(embedding)[:5]')} as top from embeddings")
def _(t):
    return t.embeddings.select("vec_id", _text(arrays.k_largest("embedding", 5)).alias("top"))


@query("agg_16_mean_by_position", """
with c as (select label, unnest(embedding)::DOUBLE as x, unnest(range(64))::INTEGER as pos from embeddings)
select label, pos, round(avg(x), 6) + 0.0 as m from c group by all""")
def _(t):
    means = vectors.mean_by_position(t.embeddings, ["label"], "embedding")
    return means.select("label", F.posexplode("mean").alias("pos", "m")).withColumn("m", r("m", 6))


@query("agg_17_group_sizes", "select label, count(*) as n, count(*) filter (len(list_filter(embedding, lambda x: x > 0)) < 30) as short from embeddings group by label")
def _(t):
    x = t.embeddings.select("label", F.filter("embedding", lambda x: x > 0).alias("e"))
    return vectors.group_sizes(x, "label", "e", 30)


@query("arr_10_mean_word_vectors", """
with c as (select l_orderkey, unnest(embedding)::DOUBLE as x, unnest(range(64))::INTEGER as pos from lineitem join embeddings on vec_id = l_partkey),
m as (select l_orderkey, pos, avg(x) as m from c group by all), n as (select l_orderkey, sqrt(sum(m * m)) as norm, sum(m) as total from m group by l_orderkey)
select k.l_orderkey, round(coalesce(norm, 0), 6) as norm, round(coalesce(total, 0), 6) + 0.0 as total from (select distinct l_orderkey from lineitem) k left join n using (l_orderkey)""")
def _(t):
    tokens = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("word"))
    vecs = t.embeddings.select(F.col("vec_id").alias("word"), F.col("embedding").alias("vec"))
    out = vectors.mean_word_vectors(tokens, "l_orderkey", "word", vecs, 64)
    return out.select("l_orderkey", r("norm", 6).alias("norm"), r(arrays.total("vec"), 6).alias("total"))


# -- matching ----------------------------------------------------------------------------------

@query("jon_5_exact_coverage", f"""
with d as (select unnest({tok('lower(text)')}) as w from documents), c as (select distinct unnest({tok('lower(text)')}) as w from benchmark)
select count(*) as total, count(distinct w) as distinct_total, count(*) filter (w in (select w from c)) as hits, count(distinct w) filter (w in (select w from c)) as distinct_hits from d""")
def _(t):
    words = lambda df: df.select(F.explode(tr.tokens(F.lower("text"))).alias("w"))
    return match.exact_coverage(words(t.documents), "w", words(t.benchmark), "w")


@query("jon_6_contained_in_any", """
with s as (select distinct trim(unnest(string_split(text, '.'))) as s from benchmark)
select s from s where s <> '' and exists (select 1 from documents d where contains(d.text, s.s))""")
def _(t):
    pieces = t.benchmark.select(F.explode(F.split("text", r"\.")).alias("s")).select(F.trim("s").alias("s"))
    return match.contained_in_any(pieces, "s", spread(t.documents, "doc_id"), "doc_id", "text")


UNIT_SQL = """cells as (select vec_id, label, unnest(embedding)::DOUBLE as x, unnest(range(64)) as pos from embeddings),
units as (select vec_id, label, pos, x / sqrt(sum(x * x) over (partition by vec_id, pos < 32)) as u, x / sqrt(sum(x * x) over (partition by vec_id)) as w from cells)"""


@query("jon_7_best_match", f"""with {UNIT_SQL},
s as (select a.vec_id as left_id, b.vec_id as right_id, round(sum(a.u * b.u * (case when a.pos < 32 then 0.6 else 0.3 end)::DOUBLE), 9) as score
  from units a join units b on a.pos = b.pos where a.label < 8 and b.label >= 8 group by all)
select left_id, arg_max(right_id, (score, -right_id)) as right_id, round(max(score), 6) + 0.0 as score from s group by left_id""")
def _(t):
    found = parts.best_by_parts(t.embeddings.where("label < 8"), t.embeddings.where("label >= 8"), "vec_id", "embedding", [(1, 32, 0.6), (33, 32, 0.3)])
    return found.withColumn("score", r("score", 6))


NEAREST_SQL = f"""{UNIT_SQL}, sims as (select a.vec_id as left_id, b.vec_id as right_id, round(sum(a.w * b.w), 9) as score from units a join units b on a.pos = b.pos where a.vec_id <> b.vec_id group by all),
near as (select *, row_number() over (partition by left_id order by score desc, right_id) as rn from sims)"""


@query("mlf_9_nearest_words", f"with {NEAREST_SQL} select left_id, right_id, round(score, 6) + 0.0 as score from near where rn <= 10")
def _(t):
    return pivots.nearest_rows(t.embeddings, "vec_id", "embedding", 10).withColumn("score", r("score", 6))


@query("mlf_9_pruned_neighbours", f"""with coarse as (select vec_id, unnest(embedding)::DOUBLE as x, unnest(range(64)) as pos from embeddings),
a as (select vec_id, pos, x / sqrt(sum(x * x) over (partition by vec_id)) as w from coarse), c8 as (select vec_id, pos, floor(x * 16) / 16 as x from coarse),
b as (select vec_id, pos, x / sqrt(sum(x * x) over (partition by vec_id)) as w from c8),
sims as (select a.vec_id as left_id, b.vec_id as right_id, round(sum(a.w * b.w), 9) as score from a join b on a.pos = b.pos group by all),
near as (select *, row_number() over (partition by left_id order by score desc, right_id) as rn from sims where score >= 0.9)
select left_id, right_id, round(score, 6) + 0.0 as score from near where rn <= 3""")
def _(t):
    left = t.embeddings.select(F.col("vec_id").alias("id"), vectors.unit("embedding").alias("vec"))
    coarse = F.transform("embedding", lambda x: (F.floor(x.cast("double") * 16) / 16).cast("double"))
    right = t.embeddings.select(F.col("vec_id").alias("id"), vectors.unit(coarse).alias("vec"))
    return vectors.pruned_matches(left, right, 3, 0.9, 64).withColumn("score", r("score", 6))


def _vocabulary(t):
    cats = t.embeddings.where("label < 6").join(t.labels.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select(
        F.col("vec_id").cast("string").alias("word"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"))
    near = pivots.nearest_rows(t.embeddings, "vec_id", "embedding", 10).select(
        F.col("left_id").cast("string").alias("word"), F.col("right_id").cast("string").alias("neighbour"), F.col("score").alias("sim"))
    word = F.concat((F.col("l_partkey")).cast("string"), F.when(F.col("l_linenumber") == 1, "s").otherwise(""))
    return cats, near, t.lineitem.select(word.alias("word"))


VOTES = f"""{NEAREST_SQL}, cats as (select vec_id::VARCHAR as word, 'c' || label::VARCHAR as category from embeddings where label < 6 and vec_id in (select doc_id from labels)),
known as (select left_id::VARCHAR as word, n.right_id, n.score, category from near n join cats on cats.word = n.right_id::VARCHAR where rn <= 10),
sums as (select word, category, round(sum(score), 9) as weight, string_agg(right_id::VARCHAR, '|' order by score desc, right_id::VARCHAR) as support from known group by all),
votes as (select word, category, weight, support from (select *, row_number() over (partition by word order by weight desc, category) as vr from sums) where vr = 1)"""


@query("agg_21_category_vote", f"with {VOTES} select word, category, round(weight, 6) as weight, support from votes")
def _(t):
    cats, near, _ = _vocabulary(t)
    return match.vote_category(near, cats).withColumn("weight", r("weight", 6))


CASCADE = f"""{VOTES}, occ as (select l_partkey::VARCHAR || case when l_linenumber = 1 then 's' else '' end as word from lineitem),
w as (select distinct word, regexp_replace(word, 's$', '') as bare from occ), vocab as (select vec_id::VARCHAR as word from embeddings),
casc as (select w.word, coalesce(a.category, b.category, v.category) as category,
  case when a.category is not null then 'in_dictionary' when b.category is not null then 'suffix_stripped' when v.category is not null then 'similar'
       when w.bare in (select word from vocab) then 'similar_without_category' else 'not_in_vocabulary' end as reason
  from w left join cats a on a.word = w.word left join cats b on b.word = w.bare left join votes v on v.word = w.bare)"""


@query("jon_9_category_cascade", f"with {CASCADE} select word, category, reason from casc")
def _(t):
    cats, near, occurrences = _vocabulary(t)
    return match.category_cascade(occurrences, cats, near, "s$")


@query("agg_22_cascade_report", f"""with {CASCADE}, n as (select word, reason, count(*) as n from occ join casc using (word) group by all),
t as (select reason, string_agg(word, ',' order by n desc, word) as top_words from (select *, row_number() over (partition by reason order by n desc, word) as rn from n) where rn <= 3 group by reason)
select reason, count(*) as words, sum(n)::BIGINT as rows, round(sum(n) / (select sum(n) from n), 9) as share, any_value(top_words) as top_words from n join t using (reason) group by reason""")
def _(t):
    cats, near, occurrences = _vocabulary(t)
    return match.cascade_report(occurrences, match.category_cascade(occurrences, cats, near, "s$")).withColumn("share", r("share"))


@query("jon_8_alias_groups", """
select n_nationkey::BIGINT as id, n_name as word, case when n_regionkey = 4 then 'region' else 'parent' end as role from nation
union all select s_nationkey, s_name, 'alias' from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey <> 4)""")
def _(t):
    parents = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("word"), F.col("n_regionkey").alias("type"))
    aliases = t.supplier.select(F.col("s_nationkey").cast("long").alias("id"), F.col("s_name").alias("word"))
    return match.alias_groups(parents, aliases, region_type=4)


@query("jon_10_word_vectors", """
with w as (select l_partkey as word, count(*) as n from lineitem group by all), x as (select word, n, coalesce(a.embedding, b.embedding) as vec
  from w left join embeddings a on a.vec_id = word left join (select p_partkey, p_partkey // 2 as base from part) v on v.p_partkey = word left join embeddings b on b.vec_id = v.base)
select count(*) as words, count(*) filter (vec is null) as missing, sum(case when vec is null then n else 0 end)::BIGINT as missing_rows from x""")
def _(t):
    vecs = t.embeddings.select(F.col("vec_id").alias("word"), F.col("embedding").alias("vec"))
    variants = t.part.select(F.col("p_partkey").alias("word"), F.floor(F.col("p_partkey") / 2).alias("base"))
    return match.missing_vectors(match.word_vectors(t.lineitem.select(F.col("l_partkey").alias("word")), vecs, variants))


@query("jon_11_common_neighbours", """
with e as (select distinct least(l_partkey, l_suppkey) as a, greatest(l_partkey, l_suppkey) as b from lineitem where l_partkey <> l_suppkey),
b as (select a as u, b as v from e union all select b, a from e), d as (select u, count(*) as d from b group by u),
s as (select e.a, e.b, count(*) as shared from e join b x on x.u = e.a join b y on y.u = e.b and y.v = x.v group by all)
select e.a, e.b, da.d as deg_a, db.d as deg_b, coalesce(shared, 0) as shared from e join d da on da.u = e.a join d db on db.u = e.b left join s on s.a = e.a and s.b = e.b""")
def _(t):
    return match.common_neighbours(t.lineitem, "l_partkey", "l_suppkey")


@query("mlf_11_knn_probability", f"""with {WORD_TFIDF}, train as (select r.* from rows r where doc_id in (select doc_id from labels)), test as (select r.* from rows r where doc_id not in (select doc_id from labels)),
train_ids as (select doc_id as other from documents where doc_id in (select doc_id from labels)), test_ids as (select doc_id from documents where doc_id not in (select doc_id from labels)),
shared as (select a.doc_id, b.doc_id as other, round(sum(a.w * b.w), 9) as sim from test a join train b using (term) group by all),
s as (select x.doc_id, y.other, coalesce(sim, 0) as sim from test_ids x cross join train_ids y left join shared using (doc_id, other)),
k as (select *, row_number() over (partition by doc_id order by sim desc, other) as rn from s)
select k.doc_id, round(avg(toxic), 9) as p from k join labels l on l.doc_id = other where rn <= 5 group by k.doc_id""")
def _(t):
    _, rows = textfeat.fit_transform_tfidf(t.documents, "doc_id", "text", n=(1, 2), min_df=3, max_df=0.9, sublinear=True)
    return postings.knn_probability(rows, "doc_id", t.documents, t.labels, "toxic").withColumn("p", r("p"))
