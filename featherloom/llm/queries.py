"""The operators of this subpackage over the whole tables, one query each."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from featherloom.llm import bpe, cells, exact, html, merkle, minhash, mixing, onebit, order, phrases, pii, substring, toxicity
from featherloom.llm.registry import CHECKS, QUERIES, query, table  # noqa: F401
from featherloom.session import scratch_path

WORDS_SQL = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
REACH_SQL = """both_ways as (select x as me, y as other from links union all select y, x from links),
reach as (select id, id as c from ids union select r.id, b.other from reach r join both_ways b on b.me = r.c),
comp as (select id, min(c) as component_id from reach group by id)"""


@query("op1_minhash_near_dedup", f"""
with recursive w as (select doc_id, {WORDS_SQL.format(f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')")} as ws from documents),
sh as (select distinct doc_id, s from (
  select doc_id, array_to_string(ws[i:i + 2], ' ') as s from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3)
  union all select doc_id, array_to_string(ws, ' ') from w where len(ws) in (1, 2))),
n as (select doc_id, count(*) as n from sh group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b using (s) where a.doc_id < b.doc_id group by all),
links as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 85 * (nx.n + ny.n - c)),
ids as (select doc_id as id from documents), {REACH_SQL}
select d.doc_id, coalesce(n.n, 0)::BIGINT as n_shingles, component_id, d.doc_id = component_id as kept
from documents d join comp on comp.id = d.doc_id left join n on n.doc_id = d.doc_id""")
def op1(spark, folder):
    rows = minhash.near_duplicates(table(spark, folder, "documents"), k=3, threshold=(85, 100), bands=24, rows=6)
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


@query("op2_mix_sources")
def op2(spark, folder):
    units = mixing.mix_units(table(spark, folder, "documents"))
    rows = units.withColumn("m", F.explode(F.sequence(F.lit(1), F.col("m"))))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


PII_SQL = r"""with t as (select doc_id, coalesce(text, '') as s from documents),
kinds(kind, ord, pat) as (values ('email', 1, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), ('ip', 2, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
  ('card', 3, '[0-9]([ -]?[0-9])+'), ('phone', 4, '\+[0-9][ ().0-9-]+[0-9]'), ('iban', 5, '\b[A-Z]{2}[0-9]{2}( ?[A-Z0-9]){11,30}\b'),
  ('ssn', 6, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b')),
cut as (select doc_id, kind, ord, string_split_regex(s, pat) as ps, regexp_extract_all(s, pat) as fs from t cross join kinds where regexp_matches(s, pat)),
m as (select doc_id, kind, ord, ps, fs, unnest(fs) as f, generate_subscripts(fs, 1) as i from cut),
p as (select doc_id, kind, ord, f, ps[i] as before, regexp_replace(f, '[^0-9]', '', 'g') as d, replace(f, ' ', '') as b,
  (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(fs[1:i - 1], lambda x: length(x))), 0))::BIGINT as st from m),
ok as (select doc_id, kind, ord, st, st + length(f) as en from p where case kind
  when 'ip' then len(list_filter(string_split(f, '.'), lambda x: not regexp_matches(x, '^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$'))) = 0
  when 'card' then length(d) between 13 and 19 and list_sum(list_transform(range(1, length(d) + 1), lambda j: case when j % 2 = 1 then substr(reverse(d), j, 1)::INTEGER
      else 2 * substr(reverse(d), j, 1)::INTEGER - case when substr(reverse(d), j, 1)::INTEGER > 4 then 9 else 0 end end)) % 10 = 0
  when 'phone' then length(d) between 9 and 15
  when 'iban' then length(b) between 15 and 34 and list_reduce(list_prepend(0, list_transform(string_split(substr(b, 5) || substr(b, 1, 4), ''),
      lambda c: case when c between '0' and '9' then ascii(c) - 48 else ascii(c) - 55 end)), lambda a, x: case when x > 9 then (a * 100 + x) % 97 else (a * 10 + x) % 97 end) = 1
  when 'ssn' then regexp_matches(lower(right(before, 40)), '(^|[^a-z])(ssn|social|security|tax)([^a-z]|$)') and not regexp_matches(f, '^(000|666|9)|-00-|-0000$')
  else true end),
g as (select doc_id, count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip, count(*) filter (kind = 'card') as n_card,
  count(*) filter (kind = 'phone') as n_phone, string_agg(kind || ':' || st || ':' || en, ',' order by ord, st) filter (ord <= 4) as base,
  string_agg(kind || ':' || st || ':' || en, ',' order by ord, st) as spans from ok group by doc_id)
select t.doc_id, coalesce(n_email, 0)::BIGINT as n_email, coalesce(n_ip, 0)::BIGINT as n_ip, coalesce(n_card, 0)::BIGINT as n_card, coalesce(n_phone, 0)::BIGINT as n_phone,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from t left join g using (doc_id)"""


@query("op10_find_pii", PII_SQL)
def op10(spark, folder):
    found = pii.find_pii(table(spark, folder, "documents").select("doc_id", "text"))
    base = [k.name for k in pii.BASE]
    of = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long")
    base_spans = F.filter("pii", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in base],
                        F.sha2(pii.spans_text(base_spans), 256).alias("base_sha256"), pii.spans_text(F.col("pii")).alias("spans"))


@query("op7_bpe")
def op7(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coder = bpe.Tokenizer(spark, public_tokenizers.path("word_bpe_49k.json")).fit(docs)
    return coder.encode(docs, decoded="decoded").select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op6_embedding_near_dedup", f"""
with recursive cells as (select vec_id, unnest(embedding)::DOUBLE as x, unnest(range(len(embedding))) as pos from embeddings),
u as (select vec_id, pos, x / sqrt(sum(x * x) over (partition by vec_id)) as x from cells),
links as (select a.vec_id as x, b.vec_id as y from u a join u b on a.pos = b.pos and a.vec_id < b.vec_id group by all having sum(a.x * b.x) >= 0.9),
ids as (select vec_id as id from embeddings), {REACH_SQL}
select id as vec_id, (select count(*) from both_ways where me = id)::BIGINT as n_links, component_id, id = component_id as kept from comp""")
def op6(spark, folder):
    return cells.near_vectors(table(spark, folder, "embeddings")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


@query("op9_nearest_neighbours")
def op9(spark, folder):
    rows = table(spark, folder, "embeddings")
    return onebit.nearest(rows, rows.where(F.col("vec_id") % 50 == 0))


@query("op3_toxicity")
def op3(spark, folder):
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels").select("doc_id", "toxic"))


@query("op8_html_main_text")
def op8(spark, folder):
    pages = html.extract_main_text(table(spark, folder, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op5_substring_dedup", f"""
with w as (select doc_id, {WORDS_SQL.format("coalesce(text, '')")} as ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 34], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as i from w where len(ws) >= 35)),
twice as (select k from win group by k having count(*) > 1),
gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 35)) as p from win join twice using (k))),
each as (select doc_id, unnest(ws) as x, generate_subscripts(ws, 1) as p from w),
kept as (select doc_id, string_agg(x, ' ' order by p) as t, count(*) as n from each anti join gone using (doc_id, p) group by doc_id)
select w.doc_id, len(ws)::BIGINT as n_words, (len(ws) - coalesce(n, 0))::BIGINT as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept using (doc_id)""")
def op5(spark, folder):
    return substring.remove_repeats(table(spark, folder, "documents")).drop("kept")


@query("op4_token_shards")
def op4(spark, folder):
    ranks = order.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    path = scratch_path(spark, "token-shards")
    order.write_shards(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN, path)
    rows = order.read_shards(spark, path)
    return rows.select("slot", "shard", "byte_offset", "doc_id", "part", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"))


@query("op11_exact_dedup", r"""
with t as (select doc_id, length(coalesce(text, '')) as points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as bare from documents),
g as (select doc_id, bare, first_value(doc_id) over (partition by bare order by points desc, doc_id) as keep_id, count(*) over (partition by bare) as group_size from t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(bare) as text_sha256 from g""")
def op11(spark, folder):
    return exact.exact_duplicates(table(spark, folder, "documents"), digests=True).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def _manifest_sql() -> str:
    """Levels of both trees as a chain of tables, enough for 16 ** 7 leaves a source and as many sources; a level over a lone node changes nothing."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = """(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: xor(c >> 1, (c & 1) * 3988292384))))"""
    parts = [f"""with base as (select *, {leaf("text")} as leaf, case when xor({crc}, 4294967295) % 5 = 0 then {leaf(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} else {leaf("text")} end as claim from documents),
placed as (select *, dense_rank() over (order by source nulls first) - 1 as tree, row_number() over (partition by source order by doc_id) - 1 as pos, doc_id as k from base),
c0 as (select k, tree, pos as idx, claim as cur, '' as proof from placed), n0 as (select tree, pos as idx, leaf as h from placed)"""]

    def climb(cur, nodes, tag):
        for i in range(7):
            parts.append(f"""r{tag}{i} as (select tree, idx // 16 as run, string_agg(h, '' order by idx) as s, count(*) as c, any_value(m) as m from (select *, count(*) over (partition by tree) as m from {nodes}) group by all),
n{tag}{i} as (select tree, run as idx, case when m = 1 then s else sha256(s) end as h from r{tag}{i}),
c{tag}{i} as (select k, x.tree, run as idx, case when m = 1 then cur else sha256(s[:(idx % 16) * 64] || cur || s[(idx % 16) * 64 + 65:]) end as cur,
  case when m = 1 then proof else proof || s[:(idx % 16) * 64] || s[(idx % 16) * 64 + 65:] end as proof from {cur} x join r{tag}{i} y on x.tree = y.tree and idx // 16 = run)""")
            cur, nodes = f"c{tag}{i}", f"n{tag}{i}"
        return cur, nodes

    cur, subroots = climb("c0", "n0", "a")
    parts.append(f"t0 as (select -1 as tree, tree as idx, h from {subroots}), d0 as (select k, -1 as tree, tree as idx, cur, proof from {cur})")
    cur, root = climb("d0", "t0", "b")
    return ", ".join(parts) + f"""
select doc_id, leaf, s.h as subroot, r.h as root, sha256(proof) as proof_sha256, cur as folded_root, cur = r.h as verified
from placed p join {subroots} s using (tree) cross join {root} r join {cur} x on x.k = p.k"""


@query("op13_merkle_manifest", _manifest_sql())
def op13(spark, folder):
    docs = table(spark, folder, "documents")
    lower = F.translate("text", UPPER, UPPER.lower())
    fields = lambda text: [F.col(c) for c in merkle.FIELDS[:-1]] + [text]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.merkle_proofs(docs, F.when(chosen, merkle.leaf_hash(*fields(lower))).otherwise(merkle.leaf_hash(*fields(F.col("text")))))


@query("op12_phrase_collocations", f"""
with p as (select lang, row_number() over () as id, pc from (select coalesce(lang, 'und') as lang,
    unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) as pc from documents)),
w as (select lang, regexp_extract_all(pc, '[^\\x20\\x09]+') as ws from p),
g as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, (values (1), (2), (3), (4)) v(k) where len(ws) >= k)),
f as (select lang, k, phrase, count(*) as f from g group by all),
tot as (select lang, sum(f)::BIGINT as n from f where k = 1 group by lang),
cand as (select lang, k, phrase, f as a, string_split(phrase, ' ') as ws from f where k >= 2 and f >= 30),
inner_ as (select lang, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) as phrase, a
  from cand, (values (2), (3)) v(m) where m < k),
cover as (select lang, phrase, max(a) as most from inner_ group by all),
cut as (select c.lang, c.phrase, c.a, j, array_to_string(ws[1:j], ' ') as x, array_to_string(ws[j + 1:], ' ') as y
  from (select *, unnest(range(1, k)) as j from cand) c left join cover v on v.lang = c.lang and v.phrase = c.phrase where v.most is null or 100::HUGEINT * v.most < 80::HUGEINT * c.a),
sc as (select cut.lang, cut.phrase, a, j, fx.f as l, fy.f as r, (2000000::HUGEINT * a // (fx.f::HUGEINT + fy.f))::BIGINT as score
  from cut join f fx on fx.lang = cut.lang and fx.phrase = x join f fy on fy.lang = cut.lang and fy.phrase = y),
low as (select * from sc qualify row_number() over (partition by lang, phrase order by score, j) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from low)
select lang, rank, phrase, a, l, r, n, score from ranked join tot using (lang) where rank <= 2000""")
def op12(spark, folder):
    return phrases.mine_phrases(table(spark, folder, "documents"))
