"""The contract queries of the numbered operators: thin readers that name the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracelode.llm import chat, counting, fingerprints, language, minhash, mixing, packing, pages, periods, repair, subtrees, suffixes, topk
from tracelode.sources.tables import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Class of every document: five-word shingles, similarity 0.8 or more."""
    return minhash.near_duplicates(table(spark, folder, "documents"))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every text, by models of the documents that are not held out."""
    docs = table(spark, folder, "documents")
    found = language.identify(docs, language.learn(docs))
    return found.withColumn("held_out", language.held_out(F.col("doc_id")))


def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness."""
    return fingerprints.edited(table(spark, folder, "documents"))


def op4_page_text(spark: SparkSession, folder: str) -> DataFrame:
    """The article of every page."""
    return pages.extract(table(spark, folder, "pages"))


def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    text = "</s>[INST] ok [/INST]"
    hard = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    return chat.read_back(chat.chat_segments(rows))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every text without 200-byte strings that also start elsewhere."""
    return suffixes.removed(table(spark, folder, "documents"))


def op7_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 highest inner products of every hundredth vector with all others."""
    vectors = table(spark, folder, "embeddings").select("vec_id", topk.scaled(F.col("embedding")).alias("row"))
    return topk.top_k(vectors, vectors.where(F.pmod("vec_id", F.lit(100)) == 0))


def op8_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words taken of each document when sources share all words by weights 1, 2, 3."""
    return mixing.mix_sources(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every text without 50-word windows that start in an earlier document."""
    return subtrees.removed(table(spark, folder, "documents"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document packed into sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer_path())


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of every text's words, a tenth of the texts looped beforehand."""
    return periods.digests(periods.periodic_runs(table(spark, folder, "documents"), edit=periods.looped))


def op12_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every text."""
    return counting.token_counts(table(spark, folder, "documents"), tokenizer_path())


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, damaged beforehand."""
    rows = table(spark, folder, "conversations")
    return repair.repaired(rows, repair.damaged(rows))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_language_id": op2_language_id,
    "op3_fingerprints": op3_fingerprints,
    "op4_page_text": op4_page_text,
    "op5_chat_format": op5_chat_format,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_top_k": op7_top_k,
    "op8_source_mixing": op8_source_mixing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_packing": op10_packing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_counts": op12_token_counts,
    "op13_conversation_repair": op13_conversation_repair,
}

#: op7: the scaled components once per row, then every query against all other rows.
_OP7 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as r from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, v.vec_id, list_inner_product(q.r, v.r)::bigint as score
      from v q join v on q.vec_id <> v.vec_id and len(q.r) = len(v.r) where q.vec_id % 100 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s qualify rank <= 10
"""

#: op5: digests of the turns as given; the formatted length from the template's own marks and one backslash a control string.
_OP5 = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t as (select *, len(regexp_extract_all(text, '<\\*(\|turn\|>|\|end\|>|s>|/s>)|\[\\*(INST\]|/INST\])')) as marks,
             lag(role, 1, '') over (partition by conv_id order by turn, role, text) as state,
             row_number() over (partition by conv_id order by turn desc, role desc, text desc) as back from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(len(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(len('<|turn|>' || role) + 1 + len(text) + marks + len('<|end|>') + 1)::bigint as formatted_chars,
       bool_and((state, role) in (('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'))) as valid,
       bool_and((state, role) in (('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')))
         and bool_or(back = 1 and role = 'assistant') as complete
from t group by conv_id
"""

#: op9: every window's first document, then the words that no window of an earlier document covers.
_OP9 = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) as i from d),
g as (select doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) as h from p),
f as (select h, min(doc_id) as first from g group by h),
c as (select distinct doc_id, unnest(range(i, i + 50)) as j from g join f using (h) where first < doc_id),
k as (select doc_id, list(j) as gone from c group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
       sha256(array_to_string(case when gone is null then w else list_filter(w, lambda x, j: not list_contains(gone, j)) end, ' ')) as kept_sha256
from d left join k using (doc_id)
"""

#: crc32 of ASCII text: a table of 256 values by its polynomial, then a step a character.
_CRC = """
crc(t) as (select list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
           lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) from (select 1) one),
"""
_CRC32 = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda y: ascii(y)::bigint)), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295)"

#: op11: equal six-word strings q apart, strung together to stretches; a stretch with a shorter period is no run of period q.
_OP11 = r"""
with """ + _CRC + r"""
d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
h as (select r, doc_id, w, len(w) as n, case when doc_id is null then 1 else """ + _CRC32.format("doc_id::varchar") + r""" end as h from d, crc),
a as (select *, h // 10 as g, case when n > 0 then (h // 10) % n end as a from h),
e as (select r, doc_id, n, case when h % 10 = 0 and n > 0
             then list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end]) else w end as w from a),
i as (select r, n, w, unnest(range(0, n - 5)) as i from e where n >= 12),
s as (select r, n, i, hash(w[i + 1], w[i + 2], w[i + 3], w[i + 4], w[i + 5], w[i + 6]) as s from i),
m as (select x.r, y.i - x.i as q, x.i, x.i - row_number() over (partition by x.r, y.i - x.i order by x.i) as island
      from s x join s y on x.r = y.r and x.s = y.s and x.i < y.i),
l as (select r, q, min(i) as b, max(i) + 6 + q as z from m group by r, q, island),
f as (select r, q, b, z from l where z - b >= greatest(12, 2 * q)),
u as (select * from f where not exists (select 1 from f o where o.r = f.r and o.q < f.q and o.b <= f.b and o.z >= f.z)),
k as (select r, count(*) as n_runs, string_agg(b || ',' || (z - b) || ',' || q || chr(10), '' order by b, q) as lines,
             arg_max({'b': b, 'l': z - b, 'q': q}, {'l': z - b, 'b': -b, 'q': -q}) as top from u group by r),
c as (select r, list(distinct j) as gone from (select r, unnest(range(b + q, z)) as j from u) group by r)
select e.doc_id, coalesce(n_runs, 0)::bigint as n_runs, top.b::bigint as start, top.l::bigint as length, top.q::bigint as period,
       (1000 * top.l // top.q)::bigint as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256,
       sha256(array_to_string(case when gone is null then w else list_filter(list_transform(w, lambda x, j: case when not list_contains(gone, j - 1) then x end), lambda x: x is not null) end, ' ')) as collapsed_sha256
from e left join k using (r) left join c using (r)
"""

#: op13: row by row, the least (cost, audit) of every last role; at most one insert before a row pays.
_OP13 = r"""
with recursive """ + _CRC + r"""
p as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
             """ + _CRC32.format("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')") + r""" % 20 as kind
      from conversations, crc),
x as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
             case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
             unnest(case when kind = 3 then [0, 1] else [0] end) as copy from p where kind <> 0),
o as (select coalesce(conv_id::varchar, 'null') as c, turn, role, text, row_number() over (partition by conv_id, role, text order by turn nulls first) as seen from x),
f as (select *, row_number() over (partition by c order by turn nulls first, role, text, seen) as i, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when seen > 1 then 'duplicate'
                     when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else '' end as fault,
             left(role, 1) as own, lag(left(role, 1)) over (partition by c order by turn nulls first, role, text, seen) as before from o),
g as (select c, (max(turn) - min(turn) + 1 - count(distinct turn)) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
             count(*) filter (fault = 'truncated') as truncated, count(*) filter (before is not null and before || own not in ('su', 'ua', 'au')) as illegal, max(i) as n
      from f group by c),
step(c, i, state, best) as (
  select c, 0::bigint, '', {'cost': 0, 'audit': '', 'out': ''} from g
  union all
  select c, i, state, min(best) from (
    select m.c, f.i, op.state, {'cost': m.cost + op.cost, 'audit': m.audit || op.edit,
           'out': m.out || case when op.edit = 'D' then '' else case when m.out = '' then '' else chr(10) end || case when op.edit = 'K' then f.role when op.state = 'u' then 'user' else 'assistant' end || ':' || f.text end} as best
    from (select step.c, step.i, put.state, best.cost + put.cost as cost, best.audit || put.edit as audit,
                 best.out || case when put.edit = '' then '' else case when best.out = '' then '' else chr(10) end || case when put.state = 'u' then 'user:' else 'assistant:' end end as out
          from step, lateral (select unnest(case when step.state = 'u' then [{'state': 'u', 'cost': 0, 'edit': ''}, {'state': 'a', 'cost': 2, 'edit': 'I'}]
                                                 else [{'state': step.state, 'cost': 0, 'edit': ''}, {'state': 'u', 'cost': 2, 'edit': 'I'}] end, recursive := true)) put) m
    join f on f.c = m.c and f.i = m.i + 1,
    lateral (select unnest([{'state': m.state, 'cost': 3, 'edit': 'D'},
                            {'state': f.own, 'cost': case when f.fault in ('blank', 'duplicate') or (m.state, f.own) not in (('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')) then 1000000 else (f.fault = 'truncated')::int end, 'edit': 'K'},
                            {'state': case when m.state = 'u' then 'a' else 'u' end, 'cost': case when f.fault in ('blank', 'duplicate') then 1000000 else 2 + (f.fault = 'truncated')::int end, 'edit': 'R'}], recursive := true)) op
    where op.cost < 1000000)
  group by c, i, state),
z as (select step.c, min({'cost': best.cost + case when state = 'u' then 2 else 0 end, 'audit': best.audit || case when state = 'u' then 'I' else '' end,
                          'out': best.out || case when state = 'u' then chr(10) || 'assistant:' else '' end}) as best
      from step join g on g.c = step.c and g.n = step.i where state <> 's' group by step.c)
select q.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
       coalesce(illegal, 0)::bigint as illegal, coalesce(best.cost, 0)::bigint as cost, coalesce(best.audit, '') as audit, sha256(coalesce(best.out, '')) as repaired_sha256
from (select distinct conv_id, coalesce(conv_id::varchar, 'null') as c from conversations) q left join g using (c) left join z using (c)
"""

ORACLE: dict[str, str] = {"op9_substring_dedup": _OP9, "op5_chat_format": _OP5, "op7_top_k": _OP7, "op11_periodic_runs": _OP11,
                          "op13_conversation_repair": _OP13}
