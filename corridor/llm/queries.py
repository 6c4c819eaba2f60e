"""The training-data queries and, where SQL can state them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corridor.llm import chat, decontaminate, langid, licenses, lm, mixing, quality, repair, simhash, topk, toxicity, warc, whitening
from corridor.llm.common import fold, table
from corridor.scratch import new_path, stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, table(spark, folder, "labels"), fold("doc_id", 5) != 0)
    return scored.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op2_lm_scores")
def op2_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    remainder = fold("doc_id", 7)
    return lm.score(table(spark, folder, "documents").select("doc_id", "text"), remainder == 2, remainder == 5)


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = quality.judged(docs, table(spark, folder, "labels"))
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op4_simhash")
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_components(simhash.fingerprints(table(spark, folder, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_langid")
def op5_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs, fold("doc_id", 4) != 2)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "bits", "rejected")


@query("op6_decontaminate")
def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))


def _op7_sql() -> str:
    """Base places by list slices; containment of every line with every template."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    places = " union all ".join(
        f"select rid, '{label}' as label, unnest(list_filter(range(0, len(w)), lambda i: w[i+1:i+{len(p.split())}] = {quoted(p.split())})) as spot from d"
        for p, label in licenses.PHRASES.items()
    )
    templates = ", ".join(f"('{label}', {quoted(sorted(set(t.split())))})" for label, t in licenses.TEMPLATES.items())
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with d as (select doc_id, row_number() over () as rid, {lower} as t, regexp_extract_all({lower}, {word}) as w from documents),
p as ({places}),
b as (select rid, count(*) as n_base, min(spot) as first_word, max(spot) as last_word, list_sort(list(distinct label)) as base from p group by rid),
l as (select rid, list_distinct(regexp_extract_all(unnest(string_split(t, chr(10))), {word})) as lw from d),
t(label, tw) as (values {templates}),
c as (select rid, label, len(list_intersect(lw, tw)) / len(tw)::double as containment from l, t
      where len(list_intersect(lw, tw)) >= ceil({licenses.THRESHOLD} * len(tw) - 1e-9)),
m as (select rid, max(containment) as best, list(distinct label) as found from c group by rid)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_base, 0) as n_base, cast(first_word as bigint) as first_word,
       cast(last_word as bigint) as last_word, coalesce(array_to_string(base, ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ','), '') as labels,
       case when n_base > 0 then 1.0::double else coalesce(best, 0.0::double) end as score
from d left join b using (rid) left join m using (rid)
"""


@query("op7_license_scan", _op7_sql())
def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score",
    )


_QUARTER = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * g + 1}, 5))::int >> {15 - 5 * k}) & 31) + 1, 1)" for g in range(8) for k in range(4))
OP8_SQL = f"""
with p as (select page_id, sha1(coalesce(html, '')) as h, octet_length(encode(coalesce(html, ''))) as n from pages),
f as (select *, max(page_id) over (partition by h, n) as first from p)
select page_id, cast(n as bigint) as payload_bytes, {_QUARTER} as payload_digest,
       case when page_id = first or n < {warc.LEAST_BYTES} then 'response' else 'revisit' end as record_type,
       case when page_id <> first and n >= {warc.LEAST_BYTES} then first end as refers_to
from f
"""


@query("op8_warc", OP8_SQL)
def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    written = warc.write_warc(table(spark, folder, "pages"), new_path(spark, "warc"))
    read = warc.read_warc(written).drop("payload")
    number = lambda c: F.regexp_extract(c, "^urn:page:(.+)$", 1).try_cast("long")
    return read.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to_id").alias("refers_to")
    )


OP9_SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         ('0x' || substr(md5(coalesce(cast(doc_id as varchar), text, '') || ':17'), 1, 12))::bigint / 281474976710656.0::double as spot
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
w as (select *, row_number() over (order by encode(source) asc nulls last) - 1 as sid from s),
x as (select *, [5.0::double, 2.0, 1.0][cast(sid % 3 as int) + 1] as weight, source_size * 2.0::double as most from w),
y as (select *, most / weight as full_at, sum(source_size) over () * 1.5::double as wanted, sum(weight) over () as all_weight from x),
z as (select *, (wanted - coalesce(sum(most) over b, 0.0::double)) / (all_weight - coalesce(sum(weight) over b, 0.0::double)) as level
      from y window b as (order by full_at, sid rows between unbounded preceding and 1 preceding)),
v as (select arg_min(level, row(full_at, sid)) filter (where level <= full_at) as level from z),
t as (select source, source_size, least(most, coalesce(v.level * weight, most)) as target from z, v),
q as (select *, cast(floor(target + 0.5) as bigint) as quota from t),
d as (select sized.*, source_size, target, quota, greatest(source_size, 1) as whole,
             coalesce(sum(size) over (partition by sized.source order by spot, size, cast(doc_id as varchar)
                      rows between unbounded preceding and 1 preceding), 0) as past
      from sized join q on sized.source is not distinct from q.source)
select doc_id, cast(size as bigint) as size, source_size, target,
       cast((quota // whole) * size + greatest(0, least(size, quota % whole - past)) as bigint) as taken
from d
"""


@query("op9_mixing", OP9_SQL)
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    rows = mixing.sized(docs).withColumn("row", F.struct(F.col("row.doc_id").alias("doc_id")))
    mixed = mixing.allocate(stored(rows, "mix-sizes"))
    return mixed.select("row.doc_id", "size", "source_size", "target", mixing.taken_words().alias("taken"))


OP10_SQL = f"""
with m as (select distinct conv_id, turn, case when trim(role) <> '' then role else 'unknown' end as speaker, coalesce(text, '') as text
           from conversations),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, encode(speaker), encode(text)) - 1 as position from m),
p as (select distinct conv_id, speaker as perspective from m where speaker <> '{chat.SYSTEM}'),
v as (select o.conv_id, perspective, position, position // {chat.PART_TURNS} as part, speaker = perspective as own,
             case when speaker = perspective then '{chat.START}assistant' when speaker = '{chat.SYSTEM}' then '{chat.START}system'
                  else '{chat.START}user name=' || replace(speaker, '<|', '<' || chr(92) || '|') end || chr(10) as head,
             replace(text, '<|', '<' || chr(92) || '|') || '{chat.END.strip()}' || chr(10) as body
      from o join p on o.conv_id is not distinct from p.conv_id),
a as (select *, length(head) + length(body) as size,
             coalesce(sum(length(head) + length(body)) over (partition by conv_id, perspective, part order by position
                      rows between unbounded preceding and 1 preceding), 0) as spot from v),
g as (select conv_id, perspective, part, count(*) as n_turns, count(*) filter (where own) as n_own_turns, sum(size) as size,
             string_agg(head || body, '' order by position) as rendered,
             coalesce(sum(length(body)) filter (where own), 0) as mask_chars,
             coalesce(string_agg(cast(spot + length(head) as bigint) || '-' || cast(spot + size as bigint), ',' order by position) filter (where own), '') as mask
      from a group by conv_id, perspective, part)
select conv_id, perspective, cast(part as bigint) as part,
       cast(coalesce(sum(size) over (partition by conv_id, perspective order by part rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset",
       n_turns, n_own_turns, rendered, mask, cast(mask_chars as bigint) as mask_chars
from g
"""


@query("op10_chat_rotation", OP10_SQL)
def op10_chat_rotation(spark: SparkSession, folder: str) -> DataFrame:
    views = chat.rotate(table(spark, folder, "conversations"))
    spans = F.array_join(F.transform("mask", lambda s: F.concat(s["start"], F.lit("-"), s["end"])), ",")
    return views.withColumn("mask", spans)


OP11_SQL = f"""
with v as (select row_number() over () as rid, vec_id, list_transform(embedding, lambda c: cast(floor({topk.SCALE} * cast(c as double)) as bigint)) as x
           from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0),
s as (select q.rid, q.vec_id as query_id, c.vec_id,
             cast(list_sum(list_transform(list_zip(q.x, c.x), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) as bigint) as score
      from v q join v c on q.rid <> c.rid where q.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by rid order by score desc, vec_id nulls last) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= {topk.K}
"""


@query("op11_topk", OP11_SQL)
def op11_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings")).select("query_id", "rank", "vec_id", "score")


@query("op12_whitening")
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))



def _op13_sql() -> str:
    """The damage by a byte-wise crc32, and the edits by a recursion over the rows of each conversation from its end."""
    blank = r"'[^\x20\x09-\x0D]'"
    wanted, after, names = repair.WANTED, repair.AFTER, repair.NAMES

    def option(cost: str, letter: str, then: str, line: str | None = None) -> str:
        text = f"{then}.t" if line is None else f"{line} || coalesce(chr(10) || {then}.t, '')"
        return f"{{'c': ({cost} + {then}.c)::bigint, 'a': '{letter}' || {then}.a, 't': {text}}}"

    def base(state: int) -> str:
        to = f"s{after[state]}"
        keep = f"when not gone and class = '{wanted[state]}' then {option('3 * cut', 'K', to, 'line')}"
        if state == 0:
            keep += f" when not gone and class = 's' then {option('3 * cut', 'K', 's1', 'line')}"
        role = names[wanted[state]]
        rerole = option("3 + 3 * cut", "R", to, f"'{role}:' || text")
        options = f"[{option('4', 'D', f's{state}')}, case {keep} end, case when not gone then {rerole} end]"
        return f"list_sort(list_filter({options}, lambda x: x is not null))[1] as b{state}"

    def inserted(state: int, then: str, name: str) -> str:
        line = f"'{names[wanted[state]]}:'"
        return f"list_sort([b{state}, {option('3', 'I', then, line)}])[1] as {name}"

    ends = "{'c': 0::bigint, 'a': '', 't': null::varchar}", "{'c': 6::bigint, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}", \
        "{'c': 3::bigint, 'a': 'I', 't': 'assistant:'}", "{'c': 0::bigint, 'a': '', 't': null::varchar}"
    return f"""
with recursive k as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
                        lambda c, n: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as steps),
c as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
             coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
h as (select c.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::bigint)),
                      lambda a, b: xor(steps[(xor(a, b) & 255) + 1], a // 256)), 4294967295) % 20 as kind from c, k),
d as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
             case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
             unnest(case when kind = 3 then [0, 1] else [0] end) as copy from h where kind <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, encode(role), md5(length(role) || ':' || role || text)) as pos,
             not regexp_matches(text, {blank}) as blank from d),
f as (select *, not blank and row_number() over (partition by conv_id, role, text order by pos) > 1 as again,
             case when role[1] in ('s', 'u', 'a') then role[1] else 'o' end as class,
             regexp_extract_all(text, {blank})[-1] not in ('.', '!', '?') as open, role || ':' || text as line from o),
g as (select *, blank or again as gone, case when not blank and not again and open then 1 else 0 end as cut,
             lag(class) over (partition by conv_id order by pos) || class as pair from f),
dp as (select conv_id, max(pos) + 1 as i, {', '.join(f'{e} as s{n}' for n, e in enumerate(ends))} from g group by conv_id
       union all
       select conv_id, i, {inserted(0, 'z2', 's0')}, {inserted(1, 'z2', 's1')}, z2 as s2, z3 as s3 from (
         select *, {inserted(2, 'b3', 'z2')}, {inserted(3, 'b2', 'z3')} from (
           select dp.conv_id, dp.i - 1 as i, {', '.join(base(n) for n in range(4))}
           from dp join g on g.conv_id is not distinct from dp.conv_id and g.pos = dp.i - 1))),
e as (select conv_id, s0.c as cost, s0.a as audit, sha256(coalesce(s0.t, '')) as repaired_sha256 from dp where i = 1),
n as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where blank) as blank,
             count(*) filter (where again) as duplicate, sum(cut)::bigint as truncated,
             count(*) filter (where pair is not null and pair not in ('su', 'ua', 'au')) as illegal from g group by conv_id),
w as (select distinct conv_id from conversations)
select w.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost,
       coalesce(audit, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from w left join n on w.conv_id is not distinct from n.conv_id left join e on w.conv_id is not distinct from e.conv_id
"""


@query("op13_repair", _op13_sql())
def op13_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return repair.report(repair.damage(rows), rows)
