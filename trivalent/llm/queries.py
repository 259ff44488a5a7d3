"""The registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, decontamination, html_text, licenses, line_dedup, line_quality, pii, prefix_trie, rules, simhash, spelling,
    suffix_dedup, token_counts,
)
from .common import read


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(read(spark, sf_dir, "documents")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = line_quality.train(docs, read(spark, sf_dir, "labels"))
    scored = line_quality.score(docs, model)
    return scored.select("doc_id", line_quality.held_out().alias("held_out"), "score", "predicted")


def op4_rule_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(read(spark, sf_dir, "documents"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op7_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.benchmark_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("n_lines", F.size(F.split("text", "\n", -1)))
    found = line_dedup.remove_repeated_passages(docs)
    removed = F.aggregate("removed_ranges", F.lit(0), lambda n, r: n + r["stop"] - r["start"] + 1)
    return found.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeated_bytes(read(spark, sf_dir, "documents"), length=200)
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return found.select(
        "doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(read(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii, op2_token_counts, op3_line_quality, op4_rule_votes, op5_bpe_round_trip, op6_simhash_near_dedup,
        op7_benchmark_hits, op8_repeated_passages, op9_html_text, op10_license_scan,
        op11_spelling_variants, op12_suffix_dedup, op13_prefix_trie,
    )
}
#: Common table expression with the 256 remainders of the CRC-32 polynomial as one list, and the checksum of a hexadecimal string.
CRC_TABLE = """
        crc as (
            select list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, x:
                case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as remainders)"""


def crc_sql(hexed: str) -> str:
    bytes_of = f"list_transform(range(len({hexed}) // 2), lambda i: ('0x' || substr({hexed}, 2 * i + 1, 2))::bigint)"
    return (
        f"xor(list_reduce([4294967295::bigint] || {bytes_of}, lambda c, b: "
        "xor(c >> 8, remainders[(xor(c, b) & 255) + 1])), 4294967295)")


ORACLE: dict[str, str] = {
    "op8_repeated_passages": r"""
        with docs as (
            select doc_id, text, string_split(text, chr(10)) as s from documents where doc_id is not null and text is not null),
        lines as (
            select doc_id, text, unnest(range(len(s))) as pos, unnest(s) as line, unnest(list_append(s[2:], null)) as next_line
            from (select distinct doc_id, text, s from docs)),
        rolled as (
            select *, next_line is null or md5(md5(line) || md5(next_line)) like '0%' as cut,
                len(regexp_extract_all(line, '[^ \t-\r]+')) as words from lines),
        often as (select line, count(*) as n from rolled group by line having count(*) > 1),
        pairs as (select line, next_line, count(*) as n from rolled where not cut group by all having count(*) > 1),
        glued as (
            select p.line, p.next_line from pairs p join often a on p.line = a.line and p.n = a.n
            join often b on p.next_line = b.line and p.n = b.n),
        marked as (
            select r.*, g.line is not null as glue from rolled r join often using (line)
            left join glued g on r.line = g.line and r.next_line = g.next_line),
        fresh as (
            select *, coalesce(pos - lag(pos) over w > 1 or not lag(glue) over w, true)::int as is_fresh from marked
            window w as (partition by doc_id, text order by pos)),
        numbered as (select *, sum(is_fresh) over (partition by doc_id, text order by pos) as chunk from fresh),
        chunks as (
            select doc_id, text, chunk, min(pos) as start, max(pos) as stop, sum(words) as words, string_agg(line, chr(10) order by pos) as passage
            from numbered group by doc_id, text, chunk),
        firsts as (
            select passage, min(doc_id) as first_id from chunks group by passage having min(doc_id) < max(doc_id)),
        again as (select c.* from chunks c join firsts using (passage) where c.doc_id <> first_id),
        again_fresh as (
            select *, coalesce(start - lag(stop) over (partition by doc_id, text order by start) > 1, true)::int as is_fresh from again),
        again_runs as (select *, sum(is_fresh) over (partition by doc_id, text order by start) as run from again_fresh),
        removed as (
            select doc_id, text, min(start) as start, max(stop) as stop from again_runs group by doc_id, text, run having sum(words) >= 50),
        kept as (
            select l.doc_id, l.text, string_agg(l.line, chr(10) order by l.pos) as kept from lines l
            where not exists (select 1 from removed r where r.doc_id = l.doc_id and r.text = l.text and l.pos between r.start and r.stop)
            group by l.doc_id, l.text),
        changed as (select doc_id, text, sum(stop - start + 1) as n_removed from removed group by doc_id, text),
        result as (
            select d.doc_id, len(string_split(d.text, chr(10))) as n_lines, coalesce(c.n_removed, 0) as n_removed,
                case when c.doc_id is null then d.text else coalesce(k.kept, '') end as kept
            from documents d left join changed c on d.doc_id = c.doc_id and d.text = c.text
            left join kept k on d.doc_id = k.doc_id and d.text = k.text)
        select doc_id, n_lines::bigint as n_lines, n_removed::bigint as n_removed, length(kept)::bigint as n_chars, sha256(kept) as kept_sha256
        from result
    """,
    "op12_suffix_dedup": r"""
        with docs as (
            select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
        starts as (
            select r, i, md5(substring(h, 2 * i + 1, 400)) as w
            from (select r, h, unnest(range(0, len(h) // 2 - 199)) as i from docs)),
        again as (select w from starts group by w having count(*) > 1),
        hits as (
            select r, i, coalesce(i > 200 + lag(i) over (partition by r order by i), true)::int as fresh
            from starts join again using (w)),
        runs as (select r, i, sum(fresh) over (partition by r order by i) as run from hits),
        spans as (select r, run, min(i) as a, max(i) + 200 as b from runs group by r, run),
        gaps as (
            select r, coalesce(lag(b) over (partition by r order by a), 0) as k_from, a as k_to from spans
            union all select r, max(b), null from spans group by r),
        kept as (
            select g.r, string_agg(substring(h, 2 * k_from + 1, 2 * (coalesce(k_to, len(h) // 2) - k_from)), '' order by k_from) as kept
            from gaps g join docs using (r) group by g.r),
        gone as (select r, sum(b - a) as n_removed, count(*) as n_spans from spans group by r)
        select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed,
            coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
        from docs left join gone using (r) left join kept using (r)
    """,
    "op13_prefix_trie": rf"""
        with {CRC_TABLE.strip()},
        turns as (
            select conv_id, row_number() over (partition by conv_id order by turn nulls first) - 1 as pos,
                {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} as t
            from conversations where conv_id is not null),
        convs as (
            select c.conv_id, c.ts, f.ts as lent, {crc_sql("hex(encode(c.conv_id::varchar))")} % 9 as h
            from (select conv_id, list(t order by pos) as ts from turns group by conv_id) c
            left join (select conv_id, list(t order by pos) as ts from turns group by conv_id) f on f.conv_id = c.conv_id - c.conv_id % 5,
            crc),
        paths as (select conv_id, coalesce(lent[:h], []) || ts[h + 1:] as ts from convs),
        steps as (
            select conv_id, d, ts[:d] as prefix, len(ts) = d as ends, case when d > 0 then ts[:d - 1] end as parent
            from (select conv_id, ts, unnest(range(len(ts) + 1)) as d from paths)),
        nodes as (
            select prefix, any_value(parent) as parent, min(conv_id) as conv_id, any_value(d) as depth, count(*) as n,
                coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '') as ids,
                (count(*) - 1) * coalesce(octet_length(encode(any_value(prefix[d].text))), 0) as saved
            from steps group by prefix),
        up as (select n.*, c.n as n_children from nodes n left join (select parent, count(*) as n from nodes where depth > 0 group by parent) c
            on c.parent = n.prefix),
        below as (
            select prefix[:a] as prefix, sum(saved) as saved, sum((n_children is null)::int) as leaves
            from (select *, unnest(range(depth + 1)) as a from up) group by 1)
        select u.conv_id, u.depth::bigint as depth, p.conv_id as parent_conv_id, u.n::bigint as n_convs,
            coalesce(u.n_children, 0)::bigint as n_children, b.leaves::bigint as n_leaves, b.saved::bigint as saved_tokens,
            sha256(u.ids) as ends_sha256
        from up u join below b using (prefix) left join nodes p on p.prefix = u.parent and u.depth > 0
    """,
    "op11_spelling_variants": rf"""
        with {CRC_TABLE.strip()},
        runs as (
            select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[a-z\x{{C0}}-\x{{FF}}]+')) as run from documents),
        counted as (select doc_id, run, count(*) as times from runs where length(run) >= 5 group by all),
        hashed as (
            select run, times, {crc_sql("hex(encode(doc_id::varchar || ':' || run))")} as h from counted, crc),
        made as (
            select times, case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word
            from hashed),
        vocabulary as (
            select word, sum(times)::bigint as n from made where length(word) >= 5 group by word having sum(times) >= 3),
        less as (
            select word, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, unnest(range(length(word))) as i from vocabulary)),
        near as (
            select a.word, b.word as other from less a join less b on a.rest = b.rest and a.i = b.i and a.word <> b.word
            union select l.word, v.word from less l join vocabulary v on v.word = l.rest
            union select v.word, l.word from less l join vocabulary v on v.word = l.rest),
        ranked as (
            select near.word, other, v.n, count(*) over (partition by near.word) as n_near,
                row_number() over (partition by near.word order by v.n desc, other) as place
            from near join vocabulary v on v.word = other),
        formed as (
            select v.word, v.n, coalesce(r.n_near, 0) as n_near, case when r.n >= 2 * v.n then other end as form,
                case when r.n >= 2 * v.n then r.n end as form_n
            from vocabulary v left join ranked r on r.word = v.word and place = 1),
        chain as (
            with recursive up as (
                select word, word as at from formed
                union all select up.word, f.form from up join formed f on f.word = up.at where f.form is not null)
            select up.word, up.at from up join formed f on f.word = up.at where f.form is null)
        select f.word, n, n_near, form, form_n, c.at as root from formed f join chain c using (word)
    """,
}
