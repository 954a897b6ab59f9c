"""Text cleaning, counting, section, topic, sequence and TF-IDF queries."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from featherloom.catalog.common import r
from featherloom.catalog.registry import query
from featherloom.functions import dictionaries, textrules as tr
from featherloom.operators import encode, textfeat
from featherloom.session import spread

STOPS = ["the", "of", "and", "und", "der", "les", "que"]


def docs(t):
    """The documents, spread over the cores if they sit in a few splits only."""
    return spread(t.documents, "doc_id")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(quoted(w) for w in words) + ")"


def rx(expr: str, rules) -> str:
    """The rule list as nested DuckDB calls."""
    for pattern, replacement in rules:
        expr = f"regexp_replace({expr}, {quoted(pattern)}, {quoted(replacement.replace('$1', chr(92) + '1'))}, 'g')"
    return expr


def tok(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, '\\s+'), lambda w: w <> '')"


def has_any(expr: str, words) -> str:
    return "(" + " or ".join(f"contains({expr}, {quoted(w)})" for w in words) + ")"


CLEAN = rx("lower(" + rx("text", tr.COMMENT_BEFORE_LOWER) + ")", tr.COMMENT_AFTER_LOWER)


@query("str_1_clean_comment", f"select doc_id, {CLEAN} as text from documents")
def _(t):
    return docs(t).select("doc_id", tr.clean_comment("text").alias("text"))


@query("str_2_clean_question", f"""
select doc_id, {rx(f"array_to_string(list_filter({tok('lower(text)')}, lambda w: w not in {in_list(STOPS)}), ' ')", tr.QUESTION_RULES)} as text from documents""")
def _(t):
    return docs(t).select("doc_id", tr.clean_question("text", STOPS).alias("text"))


@query("str_3_stop_words", f"""
select doc_id, array_to_string(list_filter({tok('lower(text)')}, lambda w: w not in {in_list(STOPS)}), ' ') as text from documents""")
def _(t):
    return docs(t).select("doc_id", tr.remove_stop_words(F.lower("text"), STOPS).alias("text"))


def squeezed(expr: str) -> str:
    for c in string.ascii_lowercase:
        expr = f"regexp_replace({expr}, '{c}{{2,}}', '{c}{c}', 'g')"
    return expr


@query("str_4_squeeze_letters", f"select doc_id, {squeezed('lower(text)')} as text from documents")
def _(t):
    return docs(t).select("doc_id", tr.squeeze_letters(F.lower("text")).alias("text"))


TOKEN_MAP = {"the": "THE", "can't": "can not", "und": "and", "thth": "th"}
MAP_SQL = "list_transform({0}, lambda w: case " + " ".join(f"when w = {quoted(k)} then {quoted(v)}" for k, v in TOKEN_MAP.items()) + " else w end)"


@query("str_5_map_tokens", f"select doc_id, array_to_string({MAP_SQL.format(tok('lower(text)'))}, ' ') as text from documents")
def _(t):
    return docs(t).select("doc_id", tr.map_tokens(F.lower("text"), TOKEN_MAP).alias("text"))


@query("str_5_map_tokens_by_join", f"""
with b as (select w, 'B' || min(item_id)::VARCHAR as c from (select item_id, unnest({tok('lower(text)')}) as w from benchmark) group by w),
d as (select doc_id, unnest({tok('lower(text)')}) as w, generate_subscripts({tok('lower(text)')}, 1) as i from documents)
select d.doc_id, string_agg(coalesce(c, d.w), ' ' order by i) as text from d left join b using (w) group by d.doc_id""")
def _(t):
    table = t.benchmark.select("item_id", F.explode(tr.tokens(F.lower("text"))).alias("w")).groupBy("w").agg(
        F.concat(F.lit("B"), F.min("item_id").cast("string")).alias("c"))
    lowered = docs(t).select("doc_id", F.lower("text").alias("text"))
    return textfeat.map_tokens_by_join(lowered, "doc_id", "text", table, "w", "c")


STARRED = "replace(replace(lower(text), 'th', 't*h'), 'sc', '*s*c')"
KNOWN = ["the", "that", "schen", "this"]


@query("str_6_unmask_stars", f"""
select doc_id, replace(array_to_string(list_transform({tok(STARRED)}, lambda w: case when w = 't*h' then 'masked'
  when contains(w, '*') and replace(w, '*', '') in {in_list(KNOWN)} then replace(w, '*', '') else w end), ' '), '*', ' ') as text from documents""")
def _(t):
    starred = F.replace(F.replace(F.lower("text"), F.lit("th"), F.lit("t*h")), F.lit("sc"), F.lit("*s*c"))
    return docs(t).select("doc_id", dictionaries.unmask_stars(t.spark, starred, KNOWN, {"t*h": "masked"}).alias("text"))


@query("str_7_canonical_substring", """
select doc_id, array_to_string(list_transform(string_split(lower(text), ' '), lambda w: case when contains(w, 'tion') then 'TION' when contains(w, 'th') then 'TH' else w end), ' ') as text from documents""")
def _(t):
    return docs(t).select("doc_id", dictionaries.canonical_by_substring(t.spark, F.lower("text"), [("tion", "TION"), ("th", "TH")]).alias("text"))


@query("str_8_fill_empty", """
select doc_id, case when regexp_replace(x, '\\s+', '', 'g') = '' then 'NA' else x end as trimmed, case when x = '' then 'NA' else x end as strict
from (select doc_id, regexp_replace(text, '[^0-9 ]', '', 'g') as x from documents)""")
def _(t):
    x = F.regexp_replace("text", "[^0-9 ]", "")
    return docs(t).select("doc_id", tr.fill_empty(x).alias("trimmed"), tr.fill_empty(x, strict=True).alias("strict"))


NO_STARS = f"replace(array_to_string({tok(CLEAN)}, ' '), '*', ' ')"
CHAINED = squeezed(f"array_to_string(list_filter({tok(NO_STARS)}, lambda w: w not in {in_list(STOPS)}), ' ')")


@query("str_9_clean_chain", f"""
select doc_id, case when trim(x) = '' then 'NA' else x end as text from (select doc_id, {CHAINED} as x from documents)""")
def _(t):
    steps = [tr.clean_comment, lambda c: tr.unmask_stars(c, []), lambda c: tr.remove_stop_words(c, STOPS), tr.squeeze_letters, tr.fill_empty]
    return docs(t).select("doc_id", tr.chain("text", steps).alias("text"))


@query("str_10_punctuation_and_signs", """
select doc_id, replace(replace(translate(replace(translate(text, ',.', '，。'), 'ion', '(-)'), '，、（）。；：“”－', ',,().;:""-'), '(-)', '阴性'), '(+)', '阳性') as text,
       replace(replace(replace(text, ' ', ''), 'Ca', '癌'), '子宫颈', '宫颈') as fixed from documents""")
def _(t):
    wide = F.replace(F.translate("text", ",.", "，。"), F.lit("ion"), F.lit("(-)"))
    return docs(t).select("doc_id", tr.chain(wide, [tr.ascii_punctuation, tr.sign_words]).alias("text"), tr.fix_terms("text").alias("fixed"))


@query("str_11_number_prefix", """
select doc_id, regexp_replace(text, '\\d*[.,]', '', 'g') as a, regexp_replace(text, '\\d*\\.', '', 'g') as b from documents""")
def _(t):
    return docs(t).select("doc_id", tr.drop_number_prefix("text").alias("a"), tr.drop_list_number("text").alias("b"))


@query("str_12_after_marker", """
select doc_id, case when contains(text, 'the ') then substr(text, instr(text, 'the ') + 4) else text end as text from documents""")
def _(t):
    return docs(t).select("doc_id", tr.after_marker("text", "the ").alias("text"))


@query("str_13_clean_record", f"""
select doc_id, {rx("translate(replace(text, ' en ', '，一，(x) 5mg 次/分'), '，。；：？“”、／（）', ',.;:?" + '""' + ",/()')", tr.RECORD_RULES)} as text,
       {rx("replace(replace(text, 'th', ',姓名x,'), 'er', ',年龄y,')", tr.PERSON_RULES)} as person from documents""")
def _(t):
    x = F.replace("text", F.lit(" en "), F.lit("，一，(x) 5mg 次/分"))
    p = F.replace(F.replace("text", F.lit("th"), F.lit(",姓名x,")), F.lit("er"), F.lit(",年龄y,"))
    return docs(t).select("doc_id", tr.clean_record(x).alias("text"), tr.drop_person_info(p).alias("person"))


PREPARED = rx("translate(lower(text), chr(10) || chr(9) || chr(8) || chr(13), '    ')", tr.CHAR_GRAM_CONTRACTIONS)
WORDS = f"""array_to_string(list_transform(string_split_regex(regexp_replace({PREPARED}, '^\\s+|\\s+$', '', 'g'), '\\s+'),
  lambda w: regexp_replace(w, {quoted(tr.CHAR_GRAM_TAIL[0][0])}, '', 'g')), ' ')"""
CHAR_GRAM = f"'#' || replace({rx(WORDS, tr.CHAR_GRAM_TAIL[1:])}, ' ', '# #') || '#'"


@query("str_15_char_gram_text", f"select doc_id, {CHAR_GRAM} as text from documents")
def _(t):
    return docs(t).select("doc_id", tr.for_char_grams("text").alias("text"))


@query("str_14_count_features", f"""
with c as (select doc_id, text, {CHAR_GRAM} as clean from documents)
select doc_id, {', '.join(f"len(regexp_extract_all(text, {quoted(p)}))::INTEGER as {n}" for n, p in tr.RAW_COUNTS.items())},
  len(regexp_extract_all(text, 'th'))::INTEGER as nb_th, length(text)::INTEGER as raw_char_len,
  len(regexp_extract_all(clean, {quoted(tr.NOT_S + '+')}))::INTEGER as clean_word_len, length(clean)::INTEGER as clean_char_len,
  len(list_distinct(regexp_extract_all(clean, '(?s).')))::INTEGER as clean_chars,
  round(len(list_distinct(regexp_extract_all(clean, '(?s).'))) / (1 + least(99, length(clean))), 9) as clean_chars_ratio from c""")
def _(t):
    made = tr.count_features("text", {"nb_th": "th"})
    made["clean_chars_ratio"] = r(made["clean_chars_ratio"])
    return docs(t).select("doc_id", *[c.alias(n) for n, c in made.items()])


@query("str_16_substring_counts", """
select doc_id, ((length(text) - length(replace(text, 'tion', ''))) / 4)::INTEGER as n_tion, ((length(text) - length(replace(text, 'und', ''))) / 3)::INTEGER as n_und from documents""")
def _(t):
    counted = docs(t).select("doc_id", dictionaries.part_counts(t.spark, "text", ["tion", "und"]).alias("counts"))
    return counted.select("doc_id", *[dictionaries.count_of(F.col("counts"), p).alias(f"n_{p}") for p in ("tion", "und")])


@query("str_17_longest_sentence", """
with s as (select conv_id, turn, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) as s from conversations)
select conv_id, turn, max(len(regexp_extract_all(s, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\t-\\r\\x1c-\\x1f\\x{85}\\p{Z}]+')))::INTEGER as n from s group by all""")
def _(t):
    return t.conversations.select("conv_id", "turn", tr.longest_sentence("text").alias("n"))


PIECES = """pieces as (select page_id, list_filter(list_transform(regexp_extract_all(replace(html, 'code-system=""', '>'), '>{1,2}([^\\n]*?)<', 1),
  lambda x: regexp_replace(replace(x, '　', ''), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as p from pages)"""


@query("str_18_markup_pieces", f"with {PIECES} select page_id, i::INTEGER as i, x as piece from (select page_id, unnest(p) as x, generate_subscripts(p, 1) - 1 as i from pieces)")
def _(t):
    return t.pages.select("page_id", F.posexplode(tr.markup_pieces("html")).alias("i", "piece"))


BEGIN, END = ("is", "der"), ("the", "und", "es")


@query("str_19_sections", f"""
with {PIECES}, marked as (select page_id, p, list_filter(range(2, len(p) + 1), lambda i: {has_any('p[i]', BEGIN)}) as b,
    list_filter(range(1, len(p) + 1), lambda i: {has_any('p[i]', END)}) as e from pieces),
stops as (select page_id, p, b, list_min(list_filter(e, lambda i: i >= list_min(b))) as stop from marked),
spans as (select page_id, p, stop, list_max(list_filter(b, lambda i: i <= stop)) as start from stops)
select page_id, case when start is null or stop is null then '' else array_to_string(p[start + 1:stop - 1], '') end as section from spans""")
def _(t):
    return t.pages.select("page_id", tr.section(tr.markup_pieces("html"), BEGIN, END).alias("section"))


@query("str_19_record_sections", f"""
with {PIECES}, forms as (select page_id, list_concat(['出院证', 'x', '科室：内' || p[1] || '科', '床号' || p[2]], [p[3], '主诉', p[4], p[5], '现病史', p[6]]) as f from pieces)
select page_id, trim(regexp_replace('：内' || f[3][5:], '一|二|三|四|五|六|七|八|九|十|科|病区|住院|护士站|东院|康馨|：|、', '', 'g')) as department,
       f[7] || f[8] as complaint from forms""")
def _(t):
    p = tr.markup_pieces("html")
    at = lambda i: F.get("p", F.lit(i))
    form = F.array(F.lit("出院证"), F.lit("x"), F.concat(F.lit("科室：内"), at(0), F.lit("科")), F.concat(F.lit("床号"), at(1)),
                   at(2), F.lit("主诉"), at(3), at(4), F.lit("现病史"), at(5))
    x = t.pages.select("page_id", p.alias("p")).select("page_id", form.alias("f"))
    begin, end = tr.SECTIONS["complaint"]
    return x.select("page_id", tr.department("f").alias("department"), tr.section("f", begin, end).alias("complaint"))


TOPICS = [("the:", "the"), ("und", "der"), ("of",), ("Est", "est", "que"), ("absent",)]


def topic_sql(rank: int, aliases) -> str:
    alias = "case " + " ".join(f"when contains(text, {quoted(a)}) then {quoted(a)}" for a in aliases) + " end"
    return f"select doc_id, text, {rank} as rank, {alias} as topic from documents"


@query("str_20_topic_ranges", f"""
with found as ({' union all '.join(topic_sql(i, a) for i, a in enumerate(TOPICS))}),
placed as (select doc_id, text, rank, topic, instr(text, topic) as pos from found where topic is not null),
begun as (select doc_id, length(text) as n, rank, topic, case when substr(text, pos + length(topic), 1) = ':' then pos - 1
  else length(regexp_replace(substr(text, 1, pos - 1), '[^,;.]*$', '')) end as b from placed)
select doc_id, topic, b::INTEGER as begin, coalesce(lead(b) over (partition by doc_id order by b, rank), n)::INTEGER as end from begun""")
def _(t):
    return docs(t).select("doc_id", F.inline(tr.topic_ranges("text", TOPICS)))


@query("str_21_rule_label", """
select conv_id, turn, case when contains(text, 'heonha') or contains(text, 'oution') then 1
  when (contains(text, 'tion') or contains(text, 'and')) and not contains(text, 'the ') then 1 else 0 end as label from conversations""")
def _(t):
    return t.conversations.select("conv_id", "turn", tr.rule_label("text", ["heonha", "oution"], ["tion", "and"], ["the "]).alias("label"))


@query("str_22_join_to_previous", f"""
with w as (select doc_id, unnest(x) as w, generate_subscripts(x, 1) as i from (select doc_id, list_transform({tok('lower(text)')},
    lambda w: case when w in ('the', 'und', 'la') then '年' when w in ('of', 'der', 'de') then '5' when w in ('and', 'is') then '病' else w end) as x from documents)),
g as (select *, w = '年' and lag(w) over (partition by doc_id order by i) = '5' as tg, w = '病' and i > 1 as sg from w),
h as (select *, sum((not coalesce(tg, false))::INTEGER) over (partition by doc_id order by i) as tn, sum((not sg)::INTEGER) over (partition by doc_id order by i) as sn from g),
a as (select doc_id, tn, string_agg(w, '' order by i) as x from h group by all), b as (select doc_id, sn, string_agg(w, '' order by i) as x from h group by all)
select doc_id, ta as time_joined, sa as suffix_joined from (select doc_id, string_agg(x, '/' order by tn) as ta from a group by doc_id)
join (select doc_id, string_agg(x, '/' order by sn) as sa from b group by doc_id) using (doc_id)""")
def _(t):
    swap = lambda w: F.when(w.isin("the", "und", "la"), "年").when(w.isin("of", "der", "de"), "5").when(w.isin("and", "is"), "病").otherwise(w)
    x = docs(t).select("doc_id", F.transform(tr.tokens(F.lower("text")), swap).alias("x"))
    return x.select("doc_id", F.array_join(tr.join_time_words("x"), "/").alias("time_joined"), F.array_join(tr.join_suffix_words("x"), "/").alias("suffix_joined"))


ITEMS, DENY = ("the", "tion", "chen"), ("not", "on", "un")


@query("str_23_clause_facts", f"""
with c as (select doc_id, unnest(x) as c, generate_subscripts(x, 1) - 1 as clause from (select doc_id, string_split_regex(text, '[,;.]') as x from documents)),
f as (select doc_id, clause, c, item from c cross join (values ('the'), ('tion'), ('chen')) v(item) where contains(c, item))
select doc_id, clause::INTEGER as clause, item, {has_any('substr(c, 1, instr(c, item) - 1)', DENY)} as negated from f""")
def _(t):
    return docs(t).select("doc_id", F.inline(tr.clause_facts("text", ITEMS, DENY)))


@query("agg_23_fact_counters", f"""
with c as (select unnest(string_split_regex(text, '[,;.]')) as c from documents),
f as (select item, {has_any('substr(c, 1, instr(c, item) - 1)', DENY)} as negated from c cross join (values ('the'), ('tion'), ('chen')) v(item) where contains(c, item))
select item, count(*) as n, count(*) filter (not negated) as asserted from f group by item""")
def _(t):
    facts = docs(t).select(F.inline(tr.clause_facts("text", ITEMS, DENY)))
    return facts.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("negated")).alias("asserted"))


@query("str_24_group_terms", """
with terms as (select distinct p_partkey, unnest(string_split(p_name, ' ')) as term from part)
select p_partkey, case when substr(term, 1, 1) in ('a', 'b', 'c', 's') then 'norm_' || substr(term, 1, 1) else 'dummy_term' end as norm,
       string_agg(term, ',' order by term) as terms from terms group by 1, 2""")
def _(t):
    terms = t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("term"))
    categories = terms.select(F.col("term").alias("word"), F.substring("term", 1, 1).alias("category")).distinct()
    norms = categories.where(F.col("category").isin("a", "b", "c", "s")).select("category", F.concat(F.lit("norm_"), "category").alias("norm")).distinct()
    out = textfeat.group_terms(terms, "p_partkey", "term", categories, norms)
    return out.select("p_partkey", "norm", F.array_join("terms", ",").alias("terms"))


# -- counts and vocabularies -------------------------------------------------------------------

@query("agg_15_word_frequency", f"""
with w as (select unnest({tok('lower(text)')}) as word from documents)
select word, count(*) as n from w where not regexp_matches(word, '^[-+]?[0-9]+$') and not contains(word, 'mm') and not contains(word, 'cm') and word not in {in_list(STOPS)}
group by word having count(*) > 5""")
def _(t):
    return textfeat.word_frequency(docs(t), tr.tokens(F.lower("text")), 5, STOPS)


@query("agg_20_script_census", " union all ".join(f"""
select '{s}' as script, sum(len(regexp_extract_all(text, '\\p{{{s}}}')))::BIGINT as chars, count(*) filter (regexp_matches(text, '\\p{{{s}}}')) as docs from documents""" for s in textfeat.SCRIPTS))
def _(t):
    return textfeat.script_census(docs(t), "text")


BAG = f"""words as (select doc_id, unnest({tok('lower(text)')}) as word from documents),
vocab as (select word, row_number() over (order by count(*) desc, word) as idx from words group by word having count(*) > 15)"""


@query("agg_24_bag_of_words", f"with {BAG} select doc_id, idx, count(*) as n from words join vocab using (word) group by all")
def _(t):
    counts = textfeat.word_counts(t.documents, "doc_id", F.lower("text"))
    vocab = encode.frequency_codes(counts, "word", n="n").where("n > 15")
    return textfeat.bag_of_words(counts, "doc_id", None, vocab)


IDX = f"""toks as (select doc_id, unnest(x) as word, generate_subscripts(x, 1) as i from (select doc_id,
  list_filter(string_split(translate(lower(text), {quoted(textfeat.TOKEN_FILTER)}, '{' ' * len(textfeat.TOKEN_FILTER)}'), ' '), lambda w: w <> '') as x from documents)),
vocab as (select word, row_number() over (order by count(*) desc, word) as code from toks group by word),
seqs as (select doc_id, list(code order by i) as ids from toks join vocab using (word) where code < 2000 group by doc_id)"""


@query("arr_8_id_sequences", f"""with {IDX}, full_seqs as (select d.doc_id, coalesce(ids, []) as ids from documents d left join seqs using (doc_id))
select doc_id, array_to_string(case when len(ids) >= 50 then ids[len(ids) - 49:] else list_concat(list_transform(range(0, 50 - len(ids)), lambda x: 0::BIGINT), ids) end, ' ') as ids from full_seqs""")
def _(t):
    words = textfeat.index_tokens("text")
    index = textfeat.fit_token_index(docs(t), words, cap=2000)
    seqs = textfeat.id_sequences(docs(t), "doc_id", words, index, 50)
    return seqs.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("arr_8_char_sequences", """
with c as (select doc_id, unnest(regexp_extract_all(lower(text), '(?s).')) as c, generate_subscripts(regexp_extract_all(lower(text), '(?s).'), 1) as i from documents),
v as (select c, row_number() over (order by count(*) desc, c) as code from c group by c),
s as (select doc_id, list(code order by i)[:200] as ids from c join v using (c) group by doc_id)
select doc_id, list_sum(ids)::BIGINT as total, ids[1] as first_id, ids[len(ids)] as last_id from s""")
def _(t):
    chars = textfeat.char_tokens("text")
    index = textfeat.fit_token_index(docs(t), chars)
    seqs = textfeat.id_sequences(docs(t), "doc_id", chars, index, 200, side="post")
    real = F.filter("ids", lambda x: x > 0)
    return seqs.select("doc_id", F.aggregate(real, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
                       F.get(real, F.lit(0)).alias("first_id"), F.get(real, F.size(real) - 1).alias("last_id"))


@query("arr_9_tail_char_ids", f"""
with c as (select doc_id, i, substr(lower(text), length(lower(text)) - i + 1, 1) as c, length(lower(text)) as n from documents cross join range(1, 65) r(i)),
a as (select unnest(regexp_extract_all({quoted(tr.ALPHABET)}, '.')) as c, unnest(range(1, {len(tr.ALPHABET) + 1})) as idx), m as (select c, max(idx) as idx from a group by c)
select doc_id, string_agg((case when i <= n then coalesce(idx, 0) else 0 end)::VARCHAR, ' ' order by i) as ids from c left join m using (c) group by doc_id""")
def _(t):
    return docs(t).select("doc_id", F.array_join(tr.tail_char_ids("text", 64).cast("array<string>"), " ").alias("ids"))


# -- TF-IDF ------------------------------------------------------------------------------------

WORD_GRAMS = """parts as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') as p from documents),
grams as (select doc_id, unnest(list_concat(p, list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1]))) as term from parts)"""
CHAR_GRAMS = """parts as (select doc_id, unnest(p) as c, generate_subscripts(p, 1) as i from (
  select doc_id, regexp_extract_all(regexp_replace(lower(text), '\\s\\s+', ' ', 'g'), '(?s).') as p from documents)),
leads as (select doc_id, c, lead(c) over w as d, lead(c, 2) over w as e from parts window w as (partition by doc_id order by i)),
grams as (select doc_id, c || d as term from leads where d is not null union all select doc_id, c || d || e from leads where e is not null)"""
TOKEN_GRAMS = f"""toks as (select doc_id, unnest({tok(CHAR_GRAM)}) as w from documents),
grams as (select doc_id, unnest(list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3))) as term from toks)"""


def tfidf_sql(grams: str, tf: str, min_df: int, max_df: float, limit: int | None = None) -> str:
    cut = f"order by corpus desc, term limit {limit}" if limit else ""
    return f"""{grams}, tf as (select doc_id, term, count(*)::DOUBLE as tf from grams group by all), total as (select count(*)::DOUBLE as n from documents),
vocab as (select term, ln((1 + any_value(n)) / (1 + count(*))) + 1 as idf, sum(tf) as corpus from tf, total group by term
  having count(*) >= {min_df} and count(*) <= any_value(n) * {max_df}::DOUBLE {cut}),
raw as (select doc_id, term, {tf} * idf as w from tf join vocab using (term)),
rows as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as w from raw)"""


WORD_TFIDF = tfidf_sql(WORD_GRAMS, "(1 + ln(tf))", 3, 0.9)


@query("mlf_1_tfidf_word", f"with {WORD_TFIDF} select doc_id, term, round(w, 6) as w from rows")
def _(t):
    _, rows = textfeat.fit_transform_tfidf(docs(t), "doc_id", "text", n=(1, 2), min_df=3, max_df=0.9, sublinear=True)
    return rows.withColumn("w", r("w", 6))


@query("mlf_1_tfidf_char", f"with {tfidf_sql(CHAR_GRAMS, 'tf', 2, 1.0, 2000)} select doc_id, term, round(w, 6) as w from rows")
def _(t):
    _, rows = textfeat.fit_transform_tfidf(docs(t), "doc_id", "text", analyzer="char", n=(2, 3), min_df=2, max_features=2000)
    return rows.withColumn("w", r("w", 6))


@query("mlf_1_vectoriser_union", f"""
select doc_id, 'word:' || term as term, round(w, 6) as w from (with {WORD_TFIDF} select * from rows)
union all select doc_id, 'char:' || term, round(w, 6) from (with {tfidf_sql(CHAR_GRAMS, 'tf', 2, 1.0, 2000)} select * from rows)""")
def _(t):
    _, words = textfeat.fit_transform_tfidf(docs(t), "doc_id", "text", n=(1, 2), min_df=3, max_df=0.9, sublinear=True)
    _, chars = textfeat.fit_transform_tfidf(docs(t), "doc_id", "text", analyzer="char", n=(2, 3), min_df=2, max_features=2000)
    return textfeat.union_terms({"word": words, "char": chars}, "doc_id").withColumn("w", r("w", 6))


@query("mlf_1_tfidf_token_char", f"with {tfidf_sql(TOKEN_GRAMS, '1.0::DOUBLE', 1, 1.0)} select doc_id, term, round(w, 6) as w from rows")
def _(t):
    padded = docs(t).select("doc_id", tr.for_char_grams("text").alias("text"))
    _, rows = textfeat.fit_transform_tfidf(padded, "doc_id", "text", analyzer="token_char", n=(3, 3), binary=True)
    return rows.withColumn("w", r("w", 6))


@query("srt_5_top_terms", f"""with {WORD_GRAMS}
select term, count(*) as corpus_tf from grams group by term order by corpus_tf desc, term limit 1000""")
def _(t):
    counts = textfeat.term_counts(docs(t), "doc_id", "text", n=(1, 2))
    return textfeat.top_terms(counts.groupBy("term").agg(F.sum("tf").alias("corpus_tf")), 1000)


RATIO = """sizes as (select count(*) filter (toxic = 1) as np, count(*) filter (toxic = 0) as nn from labels),
ratio as (select term, ln(((1 + coalesce(sum(w) filter (toxic = 1), 0)) / (1 + any_value(np))) / ((1 + coalesce(sum(w) filter (toxic = 0), 0)) / (1 + any_value(nn)))) as r
  from rows join labels using (doc_id), sizes group by term)"""


@query("mlf_2_log_count_ratio", f"with {WORD_TFIDF}, {RATIO} select term, round(r, 6) + 0.0 as r from ratio")
def _(t):
    _, rows = textfeat.fit_transform_tfidf(docs(t), "doc_id", "text", n=(1, 2), min_df=3, max_df=0.9, sublinear=True, sliced=True)
    return textfeat.log_count_ratio(rows, t.labels, "doc_id", "toxic").withColumn("r", r("r", 6))


@query("mlf_2_scaled_rows", f"with {WORD_TFIDF}, {RATIO} select doc_id, count(*) as n, round(sum(w * r), 5) + 0.0 as total from rows join ratio using (term) group by doc_id")
def _(t):
    _, rows = textfeat.fit_transform_tfidf(docs(t), "doc_id", "text", n=(1, 2), min_df=3, max_df=0.9, sublinear=True, sliced=True)
    scaled = textfeat.scale_by_ratio(rows, textfeat.log_count_ratio(rows, t.labels, "doc_id", "toxic"), "doc_id")
    return scaled.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), r(F.sum("w"), 5).alias("total"))
