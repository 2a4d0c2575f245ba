"""The registered queries over the training-data tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import chat, dartminhash, decontaminate, lm_score, mixing, pii, quality, repair, repeats, secrets, source_audit, token_files, warc
from runlens.llm.blocks import table

TOKENIZER = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def note(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return note


@query("op1_lm_score")
def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored by word frequencies and by the suffix tree, both learnt from six sevenths."""
    return lm_score.scores(table(spark, sf_dir, "documents"))


@query("op2_warc", """
with p as (
  select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload) as payload_bytes, sha1(payload) as payload_digest from p),
k as (select payload_digest, max(page_id) as keep from d where payload_bytes >= 1000 group by payload_digest)
select page_id, payload_bytes, payload_digest,
  case when keep is not null and page_id is distinct from keep then 'revisit' else 'response' end as record_type,
  case when keep is not null and page_id is distinct from keep then keep end as refers_to
from d left join (select * from k) using (payload_digest)""")
def warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, written to archives and read back."""
    files = warc.write_archives(table(spark, sf_dir, "pages"))
    found = warc.read_archives(files, payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_repeated_strings")
def repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the documents without strings of 50 bytes that an earlier one has."""
    found = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_mixing")
def mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


@query("op5_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in the documents."""
    found = pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("spans")

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(spans).alias("spans"))


@query("op6_decontamination", r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (
  select coalesce(item_id::varchar, '') as item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
phrases as (
  select distinct item_id, w[i : i + 9] as g from (
    select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from items where len(w) > 0)),
lengths as (select distinct len(g) as n from phrases),
starts as (
  select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from words, lengths where len(w) >= n),
found as (
  select doc_id, i, n, item_id from (select doc_id, i, n, w[i : i + n - 1] as g from starts) join phrases using (g)),
hits as (
  select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(i, i + n)) as place from found)
  group by doc_id),
named as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id collate "C") as items
  from (select distinct doc_id, item_id from found) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join hits using (doc_id) left join named using (doc_id)""")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages of ten words in the documents."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.col("items"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


@query("op7_quality")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition counts and divergence from the language, with the verdict."""
    return quality.quality(table(spark, sf_dir, "documents"))


@query("op8_near_duplicates")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies that each document belongs to."""
    return dartminhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_token_files")
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' token ids, written to grammar-compressed files and read back."""
    files = token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return token_files.read_tokens(files)


@query("op10_chat", r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked as (
  select *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?<SYS>>|/SYS>>|</SYS>>|/?INST\]|/?ROLE\]|TURN\]|END\])', '\1\\\2\3', 'g') as escaped,
    regexp_replace(role, '([<\[])(\\*)(/?s>|/?<SYS>>|/SYS>>|</SYS>>|/?INST\]|/?ROLE\]|TURN\]|END\])', '\1\\\2\3', 'g') as name,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as n,
    lag(role) over (partition by conv_id order by turn nulls first, role, text) as before
  from rows)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(escaped) + case when before = role then 6 else
    case role when 'system' then 15 when 'user' then 13 when 'assistant' then 7 else 18 + length(name) end end)::bigint as formatted_chars
from marked group by conv_id""")
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as marked texts, and what can be read back from these."""
    text = "</s>[INST] ok [/INST]"
    more = spark.sql(
        f"select * from values (-7L, 0L, 'user', '{text}'), (-7L, 1L, 'assistant', '{text}') as t(conv_id, turn, role, text)"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    found = chat.format_conversations(rows).withColumn("turns", chat.read_turns(F.col("formatted")))
    found = found.withColumn("learnt", chat.learnt_text(F.col("formatted"), F.col("loss")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _more(state: str, cost: int | str, edits: str) -> str:
    """A state of the SQL below, cost in ten digits and edits, one step on."""
    return f"printf('%010d', substr({state}, 1, 10)::bigint + {cost}) || substr({state}, 11) || '{edits}'"


def _repair_sql() -> str:
    """Turn by turn over four states, each the least of cost and edits."""
    u = f"least(vu, {_more('va', 2, 'I')}, {_more('vs', 2, 'I')}, {_more('v0', 2, 'I')})"
    a = f"least(va, {_more('vu', 2, 'I')}, {_more('vs', 4, 'II')}, {_more('v0', 4, 'II')})"
    to_u = "least(v0, vs, va)"

    def keep(initial: str, state: str) -> str:
        return f"case when c = '{initial}' and not gone then {_more(state, 'cut::bigint', 'K')} end"

    def change(state: str) -> str:
        return f"case when not gone then {_more(state, 'cut::bigint + 2', 'R')} end"

    return rf"""
with recursive rows as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    list_reduce(list_concat([4294967295::bigint], flatten(list_transform(
      string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''),
      lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda x, e: case when e >= 0 then xor(x, e) else xor(x >> 1, (x & 1) * 3988292384) end) as crc
  from conversations),
kinds as (select *, xor(crc, 4294967295) % 20 as kind from rows),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) as copy
  from kinds),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, digest) as n,
    rtrim(text, E' 	

') as bare, substr(role, 1, 1) as initial
  from (select *, sha256(length(role)::varchar || ':' || role || text) as digest from damaged)),
faults as (
  select *, case when bare = '' then 'blank' when row_number() over (partition by conv_id, role, text order by n) > 1 then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    lag(initial) over (partition by conv_id order by n) as before
  from placed),
marked as (
  select *, case when initial in ('s', 'u', 'a') then initial else 'x' end as c,
    fault in ('blank', 'duplicate') as gone, fault = 'truncated' as cut from faults),
counts as (
  select conv_id, case when min(turn) is null then 0 else max(turn) - min(turn) + 1 - count(distinct turn) end as gaps,
    count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (n > 1 and before || initial not in ('su', 'ua', 'au')) as illegal
  from marked group by conv_id),
ids as (select distinct conv_id from conversations),
steps as (
  select conv_id, 0::bigint as n, '0000000000' as s0, null::varchar as ss, null::varchar as su, null::varchar as sa from ids
  union all
  select conv_id, n, {_more('v0', 3, 'D')}, least({_more('vs', 3, 'D')}, {keep('s', 'v0')}),
    least({_more('vu', 3, 'D')}, {keep('u', 'vt')}, {change('vt')}),
    least({_more('va', 3, 'D')}, {keep('a', 'vu')}, {change('vu')})
  from (
    select *, {to_u} as vt from (
      select conv_id, n, c, gone, cut, v0, vs, {u} as vu, {a} as va from (
        select m.conv_id, m.n, m.c, m.gone, m.cut, s0 as v0, ss as vs, su as vu, sa as va
        from steps s join marked m on m.conv_id is not distinct from s.conv_id and m.n = s.n + 1)))),
best as (
  select conv_id, least(s0, sa, {_more('su', 2, 'I')}, {_more('ss', 4, 'II')}) as best
  from steps qualify row_number() over (partition by conv_id order by n desc) = 1),
solved as (select conv_id, substr(best, 1, 10)::bigint as cost, substr(best, 11) as audit from best),
edits as (
  select conv_id, pos, substr(audit, pos, 1) as edit,
    sum((substr(audit, pos, 1) <> 'I')::int) over (partition by conv_id order by pos) as n,
    sum((substr(audit, pos, 1) <> 'D')::int) over (partition by conv_id order by pos) as place
  from (select conv_id, audit, unnest(range(1, length(audit) + 1)) as pos from solved)),
kept as (
  select e.*, m.role, m.text, m.c,
    max((place = 1 and edit = 'K' and m.c = 's')::int) over (partition by e.conv_id) as lead
  from edits e left join marked m on m.conv_id is not distinct from e.conv_id and m.n = e.n and e.edit <> 'I'
  where edit <> 'D'),
texts as (
  select conv_id, string_agg(case when edit = 'K' then role when (place - lead) % 2 = 1 then 'user' else 'assistant' end
    || ':' || coalesce(text, ''), chr(10) order by pos) as whole
  from kept group by conv_id)
select i.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cost, audit, sha256(coalesce(whole, '')) as repaired_sha256
from ids i left join counts k on k.conv_id is not distinct from i.conv_id
  join solved v on v.conv_id is not distinct from i.conv_id left join texts t on t.conv_id is not distinct from i.conv_id"""


@query("op12_conversation_repair", _repair_sql())
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, what is wrong with them and their cheapest repair."""
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations")))


@query("op11_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in the documents."""
    found = secrets.secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("spans")

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"].isin(*secrets.BASE))
    return found.select("doc_id", *map(count, secrets.BASE), F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(spans).alias("spans"))


@query("op13_source_divergence", r"""
with docs as (
  select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
found as (
  select doc, lang, source, term, count(*) as n from (
    select doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs)
  group by all),
terms as (select lang, term, sum(n) as n from found group by lang, term having count(*) >= 10),
sizes as (select lang, count(*) as v, sum(n) as total from terms group by lang),
every as (select distinct lang, source from docs),
counts as (select lang, source, term, sum(n) as n from found semi join terms using (lang, term) group by all),
totals as (select lang, source, coalesce(sum(n), 0) as total from every left join counts using (lang, source) group by all),
shares as (
  select e.lang, e.source, t.term, coalesce(c.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (o.total + 2 * s.v)::hugeint as p,
    1 + (1000000000::hugeint * (t.n + 2)) // (s.total + 2 * s.v)::hugeint as q
  from every e join terms t using (lang) join sizes s using (lang) join totals o using (lang, source)
    left join counts c on c.lang = e.lang and c.source = e.source and c.term = t.term),
pairs as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
parts as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
  from every a join every b on a.lang = b.lang and a.source <> b.source
    left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
  union all
  select lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) from shares where n > 0 and p > q)
select lang, source, part, item, value::bigint as value,
  row_number() over (partition by lang, source, part order by value desc, item collate "C")::int as rank
from parts qualify part = 'pair' or rank <= 10""")
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart, and the terms each one stands out by."""
    return source_audit.audit(table(spark, sf_dir, "documents"))
