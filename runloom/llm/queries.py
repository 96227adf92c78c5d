"""The queries of the training-data operators: thin readers of tables that apply one operator each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ready
from .bpe_automaton import bpe_round_trip
from .chat_format import chat_digest, chat_examples
from .decontaminate import contamination
from .html_text import html_text
from .near_dup import near_duplicates
from .ngram_join import ngram_join
from .periodic_runs import periodic_runs
from .quality import quality_rules
from .suffix_dedup import remove_repeats
from .token_counts import token_counts
from .toxicity import toxicity
from .turn_repair import conversation, structure
from .url_filters import url_filters

# Fixed rules of the query: host, path, action.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(a).alias("action")) for h, p, a in URL_RULES])))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_digest(chat_examples(rows))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes are strings of 400 bytes; n_passages and passage_bytes report passages of over 50 words, which may be shorter."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), passage_words=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"), "n_passages", "passage_bytes")


def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 by words: the passages of over 50 words that also stand elsewhere, and their bytes."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), over_words=50)
    return out.select("doc_id", "n_bytes", F.col("n_spans").alias("n_passages"), F.col("n_removed").alias("passage_bytes"))


def bpe_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them."""
    coded = bpe_round_trip(docs.select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), clean=False)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the texts, by crc32 of doc_id, repeats a stretch of words to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    cut = cut.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + floor((n - a) / (3 + g % 8))"))
    again = "concat(slice(words, 1, int(a)), slice(flatten(array_repeat(slice(words, int(a + 1), int(p)), int(ceil((n - a) / p)))), 1, int(n - a)))"
    return cut.select("doc_id", F.expr(f"if(n > 0, array_join({again}, ' '), text)").alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    greatest = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as before, -r.period as less)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), greatest.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", (-F.col("top.before")).alias("start"), "top.length", (-F.col("top.less")).alias("period"),
        F.expr("(1000 * top.length) div (-top.less)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def damaged(rows: DataFrame) -> DataFrame:
    """conversations with a row in five dropped, emptied, unpunctuated, repeated or given to the user, by crc32 of conv_id:turn."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(kind == 4, "user").otherwise(blank("role"))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))))
    return out.drop("col")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = structure(damaged(rows)).withColumn("cid", conversation()).drop("conv_id")
    all_ = rows.select("conv_id").distinct().withColumn("cid", conversation())
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return all_.join(found, "cid", "left").select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filters, op2_chat_format, op3_decontaminate, op4_toxicity, op5_minhash_near_dedup, op6_html_extraction, op7_suffix_array_dedup, op8_bpe_automaton, op9_quality_rules, op10_token_counts, op11_periodic_runs, op12_ngram_join, op13_turn_repair, repeated_passages)
}

ORACLE = {
    "op1_url_filters": """
with rules(rule, action) as (values ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'allow'), ('example.net/de/8', 'block'), ('org/es/', 'block')),
p as (select page_id,
  coalesce(translate(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(url, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
r as (select rule, action, split_part(rule, '/', 1) as h, substr(rule, length(split_part(rule, '/', 1)) + 1) as q from rules),
best as (select host, path, arg_max(rule, length(rule)) as rule, arg_max(action, length(rule)) as action
  from (select distinct host, path from p) join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, q) group by 1, 2)
select page_id, p.host, p.path, best.rule, coalesce(best.action, 'allow') as verdict from p left join best on p.host = best.host and p.path = best.path
""",
    "op2_chat_format": """
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')),
w as (select *, 15 + length(role) + length(text) + length(regexp_replace(text, '[^\\\\#<]', '', 'g')) + length(regexp_replace(role, '[^\\\\#<:]', '', 'g')) as size,
  row_number() over (partition by conv_id order by turn, role, text) as k, count(*) over (partition by conv_id) as n from c),
s as (select *, sum(size) over (partition by conv_id order by k) as upto from w)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  sum(upto) filter (role = 'assistant' or k = n)::bigint as formatted_chars
from s group by conv_id
""",
    "op3_decontaminate": """
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x != '') as w from documents),
i as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x != '') as w from benchmark),
ds as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[k:k + 4], ' ') end as s from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as k from d where len(w) > 0)),
ik as (select distinct item_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[k:k + 4], ' ') end as s from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as k from i where len(w) > 0)),
n as (select item_id, count(*) as n_item from ik group by 1)
select doc_id, item_id, n_item, count(*) as n_shared, count(*) / n_item as containment
from ds join ik using (s) join n using (item_id) group by doc_id, item_id, n_item having count(*) >= 0.75 * n_item
""",
    "op9_quality_rules": """
with d as (select doc_id, coalesce(text, '') as t from documents),
l as (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as ln from d),
lw as (select doc_id, ln, unnest(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) as word, generate_subscripts(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'), 1) as k from l),
w as (select *, row_number() over o as i, word is not distinct from lag(word) over o as again, concat_ws(' ', word, lead(word) over o, lead(word, 2) over o) as gram, count(*) over (partition by doc_id) as n from lw window o as (partition by doc_id order by ln, k)),
g as (select doc_id, i, count(*) over (partition by doc_id, gram) as times from w where i <= n - 2),
r as (select doc_id, count(distinct i + x) as n_repeat_words from g, (values (0), (1), (2)) v(x) where times > 1 group by 1),
wl as (select doc_id, ln, count(*) as n, sum(length(word)) as chars, count(*) filter (again) as stutter,
  count(*) filter (regexp_matches(word, '[.!?:;]$|[.!?:;]["'')\\]]$|[…”’。»]$')) as stops,
  count(*) filter (regexp_matches(word, '(###|\\*\\*\\*|\\$\\$\\$|%%%|&&&|\\|\\|\\||<<<|>>>)$|^[|<>/#*$%&=_~+-]([\\x00-\\x7F]?[|<>/#*$%&=_~+-])?$')) as marks from w group by 1, 2),
ll as (select l.doc_id, l.ln, line, n, chars, stops = 0 or marks > 0.25 * n or (stutter > 0.4 * n and n >= 5)
  or (length(regexp_replace(line, '[^A-Z\\x{C0}-\\x{DE}]', '', 'g')) > 4 * length(regexp_replace(line, '[^a-z\\x{DF}-\\x{FF}]', '', 'g')) and length(regexp_replace(line, '[^A-Z\\x{C0}-\\x{DE}]', '', 'g')) >= 20)
  or (n <= 12 and regexp_matches(lower(line), 'all rights reserved|cookie|privacy policy|terms of (use|service)|subscribe|sign (in|up)|log ?in|read more|click here|javascript|share this|back to top|licensed under|copyright')) as fails
  from l join wl on l.doc_id = wl.doc_id and l.ln = wl.ln),
s as (select doc_id, sum(n)::bigint as n_words, sum(chars)::bigint as word_chars, (count(*) - count(distinct line))::bigint as n_dup_lines, coalesce(sum(chars) filter (fails), 0) as lost from ll group by 1),
a as (select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(lost, 0) as lost from d left join s on d.doc_id = s.doc_id left join r on d.doc_id = r.doc_id),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from a)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and lost <= 0.5 * word_chars as kept from b
""",
}
