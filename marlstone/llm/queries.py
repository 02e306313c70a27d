"""Registered queries of the operators, with SQL where SQL can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import (
    conversations,
    decontaminate,
    embed_dup,
    lines,
    lm,
    near_dup,
    packing,
    pii,
    quality,
    token_counts,
    toxicity,
    warc,
    whitening,
)
from marlstone.llm.common import SPACES, UPPER, keep, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable) -> Callable:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op1_warc")
def op1(spark, folder):
    archives = f"{shared_dir(spark)}/warc-{os.urandom(8).hex()}"
    pages = table(spark, folder, "pages")
    index = warc.write_archives(pages, archives)
    kind = pages.schema["page_id"].dataType
    records = warc.read_records(index, archives)
    return records.select(
        F.expr("try_cast(record_id as bigint)").cast(kind).alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        "record_type",
        F.expr("try_cast(refers_to as bigint)").cast(kind).alias("refers_to"),
        "url",
        "intact",
    )


@query("op2_packing")
def op2(spark, folder):
    docs = table(spark, folder, "documents")
    pieces = packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), max_tokens=2048, end_id=1)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op3_token_counts")
def op3(spark, folder):
    store = token_counts.fresh_folder(shared_dir(spark))
    counts = token_counts.TokenCounts(spark, store, tokenizer("byte_bpe_50k.json"))
    found = counts.count(table(spark, folder, "documents"))
    return found.withColumn("over_limit", F.col("n_tokens") > 512)


_SPACES = " || ".join(f"chr({ord(c)})" for c in SPACES)
LINE_DEDUP = f"""
with d as (
  select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents
),
e as (select r, doc_id, unnest(l) as line, unnest(range(len(l))) as pos from d),
k as (select *, translate(trim(line, {_SPACES}), '{UPPER}', '{UPPER.lower()}') as key from e),
c as (select key from k where length(key) >= 1 group by key having count(distinct r) >= 10)
select doc_id, count(*) as n_lines, count(c.key) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where c.key is null), '')) as kept_sha256
from k left join c on k.key = c.key
group by r, doc_id
"""


@query("op9_line_dedup", LINE_DEDUP)
def op9(spark, folder):
    kept = lines.drop_common_lines(table(spark, folder, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op4_quality")
def op4(spark, folder):
    scored = quality.weak_quality(table(spark, folder, "documents"), threshold=0.5)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"), "p_good",
    )


@query("op5_pii")
def op5(spark, folder):
    found = pii.find_disclosures(table(spark, folder, "documents"))
    kinds = F.array(*map(F.lit, pii.KINDS))

    def joined(spans):
        named = F.transform(
            spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["stop"])
        )
        return F.array_join(named, ",")

    def count(rank):
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{pii.KINDS[rank]}")

    base = F.filter("spans", lambda s: s["rank"] < 4)
    return found.select(
        "doc_id", *map(count, range(4)), F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), count(4),
    )


@query("op6_decontamination")
def op6(spark, folder):
    found = decontaminate.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=10, near=20
    )
    items = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def remainder(id: str, by: int):
    """crc32 of an id as text, modulo ``by``; null for null."""
    return F.crc32(F.col(id).cast("string")) % by


@query("op7_toxicity")
def op7(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    index = toxicity.fit(docs, table(spark, folder, "labels"), train=remainder("doc_id", 5) != 0)
    scored = keep(toxicity.toxicity(docs, index).select("doc_id", "toxicity"))
    index.release()
    return scored.select(
        "doc_id",
        F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


@query("op8_lm_scoring")
def op8(spark, folder):
    return lm.code_lengths(table(spark, folder, "documents"), train=remainder("doc_id", 7) != 2)


@query("op10_minhash")
def op10(spark, folder):
    found = near_dup.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "class_id", "class_size")


# Equal labels only; the vectors of a label are compared pair by pair here.
EMBEDDING_LINKS = """
with recursive v as (
  select row_number() over () as r, vec_id, label, cast(embedding as double[]) as x from embeddings
),
good as (
  select * from v where label is not null and x is not null and len(x) > 0
  and len(list_filter(x, lambda c: c is null or not isfinite(c))) = 0
  and len(list_filter(x, lambda c: c <> 0)) > 0
),
links as (
  select a.r as a, b.r as b from good a join good b on a.label = b.label and a.r <> b.r and len(a.x) = len(b.x)
  where list_cosine_similarity(a.x, b.x) >= 0.93
),
reach(r, other) as (select r, r from v union select reach.r, links.b from reach join links on reach.other = links.a),
least as (select reach.r, min(v.vec_id) as component_id from reach join v on v.r = reach.other group by reach.r),
counts as (select a as r, count(*) as n from links group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from v join least using (r) left join counts using (r)
"""


@query("op11_embedding_near_dup", EMBEDDING_LINKS)
def op11(spark, folder):
    found = embed_dup.near_vectors(table(spark, folder, "embeddings"), threshold=0.93)
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns of conversations with the faults that op12 is to mend; nulls are one space."""
    space = F.lit(" ")
    kind = F.crc32(
        F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    ) % 20
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), kind.alias("kind")
    ).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"),
    )
    return rows.withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("times")


_BARE = "regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')"
CONVERSATION_REPAIR = f"""
with recursive t as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         row_number() over () as r, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key
  from conversations
),
{{crc}}
d as (
  select conv_id, turn, case kind when 4 then 'user' else role end as role,
         case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
         unnest(range(case kind when 3 then 2 else 1 end)) as again
  from k where kind <> 0
),
o as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, again) as i,
         row_number() over (partition by conv_id, role, text order by turn nulls first, again) as seen, {_BARE} as bare
  from d
),
f as (
  select *, left(role, 1) as c,
         case when bare = '' then 3 when seen > 1 then 2 when right(bare, 1) not in ('.', '!', '?') then 1 else 0 end as fault,
         lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as pair
  from o
),
stats as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count(*) filter (where fault = 3) as blank, count(*) filter (where fault = 2) as duplicate,
         count(*) filter (where fault = 1) as truncated,
         count(*) filter (where pair is not null and pair not in ('su', 'ua', 'au')) as illegal, max(i) as m
  from f group by conv_id
),
-- Of each state (what the repaired turns end with) the cheapest, least audit of the turns so far.
moves(before, letter, after) as (values ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u'), ('', 's', 's')),
states as (
  select conv_id, 0 as i, '' as state, 0 as cost, '' as audit, cast([] as varchar[]) as lines from stats
  union all
  select conv_id, i, state, best.cost, best.audit, best.lines from (
    select conv_id, i, state, min({{{{'cost': cost, 'audit': audit, 'lines': lines}}}}) as best from (
      select s.conv_id, s.i + 1 as i, s.state, s.cost + 3 as cost, s.audit || 'D' as audit, s.lines from states s
      join f on f.conv_id is not distinct from s.conv_id and f.i = s.i + 1
      union all
      select s.conv_id, s.i + 1, m.after, s.cost + f.fault + case when f.c = m.letter then 0 else 2 end,
             s.audit || case when f.c = m.letter then 'K' else 'R' end,
             list_append(s.lines, case when f.c = m.letter then f.role when m.letter = 'u' then 'user' else 'assistant' end || ':' || f.text)
      from states s join f on f.conv_id is not distinct from s.conv_id and f.i = s.i + 1
      join moves m on m.before = s.state where f.fault < 2 and (m.letter <> 's' or f.c = 's')
      union all
      select s.conv_id, s.i + 1, m.after, s.cost + 2 + f.fault + case when f.c = m.letter then 0 else 2 end,
             s.audit || 'I' || case when f.c = m.letter then 'K' else 'R' end,
             list_concat(s.lines, [case when n.letter = 'u' then 'user:' else 'assistant:' end,
               case when f.c = m.letter then f.role when m.letter = 'u' then 'user' else 'assistant' end || ':' || f.text])
      from states s join f on f.conv_id is not distinct from s.conv_id and f.i = s.i + 1
      join moves n on n.before = s.state and n.letter <> 's' join moves m on m.before = n.after
      where f.fault < 2 and m.letter <> 's'
    ) group by conv_id, i, state
  )
),
ends as (
  select s.conv_id, min({{{{
    'cost': s.cost + case s.state when 's' then 4 when 'u' then 2 else 0 end,
    'audit': s.audit || case s.state when 's' then 'II' when 'u' then 'I' else '' end,
    'lines': list_concat(s.lines, case s.state when 's' then ['user:', 'assistant:'] when 'u' then ['assistant:'] else [] end)
  }}}}) as best
  from states s join stats t on t.conv_id is not distinct from s.conv_id and t.m = s.i group by s.conv_id
)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cast(coalesce(best.cost, 0) as bigint) as cost,
       coalesce(best.audit, '') as audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join stats s on s.conv_id is not distinct from c.conv_id
left join ends e on e.conv_id is not distinct from c.conv_id
"""
# The table of crc32 from its polynomial, and its fold over the bytes of the keys, which are ASCII.
_CRC = """
bits(byte, value, k) as (
  select range, range, 0 from range(256)
  union all
  select byte, case when value & 1 = 1 then xor(value >> 1, 3988292384) else value >> 1 end, k + 1 from bits where k < 8
),
codes as (select list(value order by byte) as code from bits where k = 8),
k as (
  select t.*, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(1, length(key) + 1), lambda p: cast(ascii(substr(key, p, 1)) as bigint))),
    lambda x, y: xor(code[(xor(x, y) & 255) + 1], x >> 8)), 4294967295) % 20 as kind
  from t, codes
),
"""


@query("op12_conversation_repair", CONVERSATION_REPAIR.format(crc=_CRC.strip()))
def op12(spark, folder):
    turns = table(spark, folder, "conversations")
    found, kept = conversations.repair(damaged(turns))
    texts = conversations.digests(kept).withColumnRenamed("conv", "own")
    every = turns.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(
        texts, F.col("conv_id").eqNullSafe(F.col("own")), "left"
    )
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    gaps = F.when(F.col("n_turns").isNull(), F.lit(0)).otherwise(F.col("gaps")).cast("long").alias("gaps")
    return joined.select(
        "conv_id", gaps, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query("op13_embedding_whitening")
def op13(spark, folder):
    finite = ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = table(spark, folder, "embeddings").where(F.col("embedding").isNotNull() & finite)
    points = rows.select("vec_id", whitening.fixed_point(F.col("embedding"), 64, 1_000_000).alias("embedding"))
    return whitening.whiten(points, components=32)
