"""The registered queries of the timeline operators over the driver's tables, each with its SQL twin where SQL can say it.

events stand for keyed series (user: tile, ts: frame time, event_type: content), orders and lineitem for timed commands,
embeddings for pixel buffers, conversations and documents for sequences and assets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as X
from .functions.easing import ease
from .operators import bake, blocks, bursts, dedupe, document, fidelity, loops, render, rewrite, runs, timeline
from .plans import probes, sources, tuning
from .session import ready, shared, stash
from .sources import frames as frames_
from .sources import assets, osb, storyboard
from .streaming.runs import stream_runs

HOUR = 3_600_000
DAY = 24 * HOUR
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, event_type, value and t, milliseconds as a whole number."""
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", ms.alias("t"))


EVENTS = "ev as (select user_id, event_id, event_type, value, epoch_us(ts) // 1000 as t from events)"
RUNS = f"""{EVENTS},
r0 as (select *, case when event_type is distinct from lag(event_type) over w or row_number() over w = 1 then 1 else 0 end as c from ev window w as (partition by user_id order by t, event_id)),
r1 as (select *, sum(c) over (partition by user_id order by t, event_id) as s from r0),
r2 as (select user_id, s, min(t) as start, max(t) as last, count(*) as n, min(event_type) as content from r1 group by 1, 2),
runs as (select user_id, start, coalesce(lead(start) over (partition by user_id order by s), max(last) over (partition by user_id)) as "end", n, content from r2)"""


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.change_runs(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "t", "event_type", F.floor(F.col("t") / (7 * DAY)))


@query(f'with {RUNS} select user_id, start, "end", n::bigint as n, content from runs')
def run_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1, W3"""
    return event_runs(spark, sf_dir).select("user_id", "start", "end", "n", "content")


@query(f"""with {EVENTS}, sc as (select *, t // {3 * DAY} as scene from ev),
r0 as (select *, case when event_type is distinct from lag(event_type) over w or row_number() over w = 1 then 1 else 0 end as c from sc window w as (partition by scene, user_id order by t, event_id)),
r1 as (select *, sum(c) over (partition by scene, user_id order by t, event_id) as s from r0),
r2 as (select scene, user_id, s, min(t) as start, max(t) as last, count(*) as n, min(event_type) as content from r1 group by 1, 2, 3)
select scene, user_id, start, coalesce(lead(start) over (partition by scene, user_id order by s), max(last) over (partition by scene, user_id)) as "end", n::bigint as n, content from r2""")
def runs_by_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that begin anew with every scene of three days"""
    scenes = events(spark, sf_dir).withColumn("scene", F.floor(F.col("t") / (3 * DAY)))
    return runs.change_runs(scenes, ["scene", "user_id"], ["t", "event_id"], "t", "event_type", F.floor(F.col("t") / DAY)).select("scene", "user_id", "start", "end", "n", "content")


STREAM_WAIT = 60_000
#: R2: files that a micro-batch takes at most, so that a slow sink holds the source back
STREAM_FILES = 64


@query(f"""with {RUNS}, m as (select max(t) as latest from ev), z as (select user_id, max(s) as s from r2 group by 1),
q as (select r2.user_id, r2.start, r2.last, coalesce(lead(r2.start) over (partition by r2.user_id order by r2.s), r2.last) as "end", r2.n, r2.content, r2.s = z.s as open from r2 join z using (user_id))
select user_id, start, "end", n::bigint as n, content from q, m where not open or last + {STREAM_WAIT} < latest - {STREAM_WAIT}""")
def streamed_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs as a stream closes them; a key that is silent for a minute is closed, later ones stay open"""
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", STREAM_FILES).parquet(f"{sf_dir}/events.parquet*")
    place = shared(spark, "stream")
    closed = stream_runs(stream, "user_id", "ts", "event_type", "1 minute", STREAM_WAIT)
    work = closed.writeStream.format("parquet").option("checkpointLocation", f"{place}/state").option("path", f"{place}/out").outputMode("append").trigger(availableNow=True).start()
    work.awaitTermination()
    out = spark.read.schema(closed.schema).parquet(f"{place}/out")
    return out.select(F.col("key").alias("user_id"), F.unix_millis("start").alias("start"), F.unix_millis("end").alias("end"), "n", "content")


@query(f"""with recursive {EVENTS}, n as (select user_id, t, value, least(255, floor(value / 8) * 8 + 4)::int as step,
 row_number() over (partition by user_id order by t nulls last, value nulls last) as k from ev),
f as (select user_id, k, t, value, value as snapshot, step as opened, 1 as run from n where k = 1 union all
 select n.user_id, n.k, n.t, n.value, case when goes then snapshot else n.value end, case when goes then opened else n.step end, case when goes then run else run + 1 end
 from (select n.*, f.snapshot, f.opened, f.run, n.step = f.opened or abs(n.value - f.snapshot) <= 10 as goes from f join n on n.user_id = f.user_id and n.k = f.k + 1) n),
r as (select user_id, run, min(t) as start, max(t) as last, count(*) as n, min(snapshot) as value from f group by 1, 2)
select user_id, start, coalesce(lead(start) over (partition by user_id order by run), last) as "end", n::bigint as n, value from r""")
def tolerant_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2, F3"""
    return runs.tolerant_runs(events(spark, sf_dir), ["user_id"], "t", "value", X.quantize(F.col("value"), 32), 10.0)


@query(f"""with {RUNS}, c as (select "end" // {DAY} as day, count(*) as closed from runs group by 1)
select day, closed, closed * 1.0 / (select count(distinct user_id) from events) >= 0.7 as is_cut from c""")
def closed_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8, F11"""
    keys = table(spark, sf_dir, "events").select(F.count_distinct("user_id").alias("keys"))
    counts = runs.closed_counts(event_runs(spark, sf_dir), F.floor(F.col("end") / DAY))
    return counts.join(F.broadcast(keys)).select(F.col("bucket").alias("day"), "closed", (F.col("closed") / F.col("keys") >= 0.7).alias("is_cut"))


def _level(k: int, source: str) -> str:
    return f"""b{k} as (select day, col >> {k} as bc, "row" >> {k} as br from {source} group by all having count(*) = {4**k}),
c{k} as (select * from {source} where not exists (select 1 from b{k} where b{k}.day = {source}.day and bc = col >> {k} and br = "row" >> {k}))"""


@query(f"""with {EVENTS}, cells as (select distinct t // {DAY} as day, user_id % 16 as col, user_id // 16 as "row" from ev),
{_level(2, "cells")}, {_level(1, "c2")}
select day, bc << 2 as col, br << 2 as "row", 2 as level from b2 union all select day, bc << 1, br << 1, 1 from b1 union all select day, col, "row", 0 from c1""")
def block_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users active on a day, as cells of a grid 16 wide"""
    day = F.floor(F.col("t") / DAY)
    cells = events(spark, sf_dir).select(day.alias("day"), day.alias("start"), (F.col("user_id") % 16).alias("col"), F.floor(F.col("user_id") / 16).alias("row")).distinct()
    return blocks.roll_up(cells, ["day"], blocks.max_level(16, 16, 64, 256 * 256)).drop("start")


SINGLES = f"""{EVENTS}, s0 as (select user_id, t as start, coalesce(lead(t) over (partition by user_id order by t, event_id), t) as "end", event_type as content from ev)"""


def single_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    nxt = F.lead("t").over(Window.partitionBy("user_id").orderBy("t", "event_id"))
    return events(spark, sf_dir).select("user_id", F.col("t").alias("start"), F.coalesce(nxt, "t").alias("end"), F.col("event_type").alias("content"))


@query(f"""with {SINGLES}, s1 as (select *, "end" - start <= {12 * HOUR} as single from s0),
s2 as (select *, case when not single or not coalesce(lag(single) over w, false) or lag("end") over w is distinct from start then 1 else 0 end as b from s1 window w as (partition by user_id order by start, "end")),
s3 as (select *, sum(b) over (partition by user_id order by start, "end") as chain from s2),
s4 as (select *, (row_number() over (partition by user_id, chain order by start, "end") - 1) // 10 as part from s3 where single)
select user_id, min(start) as first, max("end") as last, count(*) as n, count(distinct content) as distinct_contents, count(*) >= 4 and count(distinct content) >= 0.8 * count(*) as promoted from s4 group by user_id, chain, part""")
def thrash_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7, W8, A9, F6"""
    return bursts.thrash_segments(single_runs(spark, sf_dir), ["user_id"], F.col("end") - F.col("start") <= 12 * HOUR, cap=10)


@query(f"""with {SINGLES}, w0 as (select *, user_id % 7 = 0 as wide from s0), s1 as (select *, "end" - start <= {12 * HOUR} as single from w0 where not wide),
s2 as (select *, case when not single or not coalesce(lag(single) over w, false) or lag("end") over w is distinct from start then 1 else 0 end as b from s1 window w as (partition by user_id order by start, "end")),
s3 as (select *, sum(b) over (partition by user_id order by start, "end") as chain from s2),
s4 as (select *, (row_number() over (partition by user_id, chain order by start, "end") - 1) // 10 as part from s3 where single),
g as (select user_id, chain, part, arg_min(start, (start, "end")) as start, arg_max("end", (start, "end")) as z, count(*) as n, string_agg(content, ',' order by start, "end", content) as contents, count(*) >= 4 and count(distinct content) >= 0.8 * count(*) as promoted from s4 group by 1, 2, 3)
select user_id, 'animation' as kind, start, z as "end", n, contents from g where promoted
union all select s4.user_id, 'sprite', s4.start, s4."end", 1, content from s4 join g on s4.user_id = g.user_id and s4.chain = g.chain and s4.part = g.part where not promoted
union all select user_id, 'sprite', start, "end", 1, content from s3 where not single union all select user_id, 'sprite', start, "end", 1, content from w0 where wide""")
def sprites_and_animations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of short runs as animations, all other runs as sprites; every seventh user's runs are merged blocks"""
    split = bursts.split_runs(single_runs(spark, sf_dir), ["user_id"], F.col("end") - F.col("start") <= 12 * HOUR, F.col("user_id") % 7 == 0, cap=10)
    return split.select("user_id", "kind", "start", "end", "n", F.array_join("contents", ",").alias("contents"))


@query(f"""with {EVENTS} select user_id, t from (select user_id, t, lag(t) over (partition by user_id order by t) as p from ev) where p is null or t - p > {12 * HOUR}""")
def burst_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9"""
    return bursts.burst_starts(events(spark, sf_dir).select("user_id", "t"), ["user_id"], "t", 12 * HOUR)


@query(f"""with recursive {EVENTS}, b as (select user_id, t from (select user_id, t, lag(t) over (partition by user_id order by t) as p from ev) where p is null or t - p > {12 * HOUR}),
a as (select user_id, min(t) as t from b group by 1 union all select a.user_id, min(b.t) from a join b on b.user_id = a.user_id and b.t >= a.t + {2 * DAY} group by a.user_id),
e as (select user_id, min(t) as t0, max(t) as t1 from ev group by 1),
m as (select user_id, t0 as t from e where t0 < t1 or true union select user_id, t1 from e union select a.user_id, a.t from a join e using (user_id) where a.t > t0 and a.t < t1)
select user_id, (row_number() over w - 1)::int as scene, t::double as start, lead(t) over w::double as "end" from m window w as (partition by user_id order by t) qualify lead(t) over w is not null""")
def scene_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes between bursts that begin two days apart at least"""
    e = events(spark, sf_dir).select("user_id", "t")
    cuts = bursts.spaced_starts(bursts.burst_starts(e, ["user_id"], "t", 12 * HOUR), ["user_id"], "t", 2.0 * DAY)
    bounds = e.groupBy("user_id").agg(F.min("t").cast("double").alias("start"), F.max("t").cast("double").alias("end")).where("start < end")
    return bursts.scenes_between(bounds, cuts, ["user_id"]).select("user_id", "scene", "start", "end")


@query(f"""with {RUNS}, s as (select user_id, min(t) as t0, max(t) as t1 from ev group by 1),
sc as (select user_id, k as scene, t0 + (t1 - t0) * k / 4.0 as s0, t0 + (t1 - t0) * (k + 1) / 4.0 as s1 from s, range(4) r(k))
select runs.user_id, scene::int as scene, greatest(start, s0)::double as start, least("end", s1)::double as "end", content from runs join sc on runs.user_id = sc.user_id and start < s1 and s0 < "end" """)
def runs_in_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs cut to the quarters of their user's time"""
    e = events(spark, sf_dir).groupBy("user_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    quarter = e.select("user_id", "t0", "t1", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("scene"))
    length = F.col("t1") - F.col("t0")
    spans = quarter.select("user_id", "scene", (F.col("t0") + length * F.col("scene") / 4.0).alias("start"), (F.col("t0") + length * (F.col("scene") + 1) / 4.0).alias("end"))
    return bursts.overlaps(event_runs(spark, sf_dir), spans, ["user_id"]).select("user_id", "scene", "start", "end", "content")


ASSETS = """assets as (select sha256(concat_ws(chr(31), coalesce(source, ''), coalesce(lang, ''), coalesce(text, ''))) as asset_key, doc_id, n_chars from documents)"""


def document_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return dedupe.assign_assets(docs, [F.col("source"), F.col("lang")], F.col("text"), "doc_id", F.col("n_chars"))


@query(f"with {ASSETS} select asset_key, min(doc_id) as first_item, count(*) as uses, arg_min(n_chars, doc_id) as size from assets group by 1")
def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as assets of a consumer (source) and palette (lang)"""
    return document_assets(spark, sf_dir)


@query(f"""with {ASSETS}, k as (select asset_key, min(doc_id) as first_item, arg_min(n_chars, doc_id) as size, bool_or(doc_id % 2 = 0) as stored from assets group by 1)
select count(*) as files, coalesce(sum(size), 0)::bigint as bytes from k where not stored""")
def unstored_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to write when the assets of even documents are stored"""
    docs = table(spark, sf_dir, "documents")
    stored = dedupe.assign_assets(docs.where("doc_id % 2 = 0"), [F.col("source"), F.col("lang")], F.col("text"), "doc_id", F.col("n_chars"))
    return dedupe.totals(dedupe.new_assets(document_assets(spark, sf_dir), stored))


@query("""with s as (select conv_id, sha256(string_agg(coalesce(role, '') || chr(30) || coalesce(text, ''), chr(31) order by turn)) as sequence_key, count(*) as frames from conversations group by 1)
select conv_id, sequence_key, frames, count(*) over (partition by sequence_key) as uses, min(conv_id) over (partition by sequence_key) as first_conv_id from s""")
def sequence_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of equal turns"""
    content = F.concat(F.coalesce("role", F.lit("")), F.lit("\x1e"), F.coalesce("text", F.lit("")))
    return dedupe.assign_sequences(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", content)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, i and a byte of each number of an embedding."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    return e.select("vec_id", "label", "i", F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("x").cast("double") + 1) * 127.5))).cast("int").alias("a"))


PIXELS = """px as (select vec_id, label, i, greatest(0, least(255, floor((x::double + 1) * 127.5)))::int as a from (select vec_id, label, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as i from embeddings)),
pq as (select *, least(255, a // 8 * 8 + 4)::int as b from px)"""
SCORES = f"""{PIXELS}, mo as (select vec_id, label, avg((a - b) * (a - b)) as mse, avg(a) as ma, avg(b) as mb, var_pop(a) as va, var_pop(b) as vb, covar_pop(a, b) as cab from pq group by 1, 2),
sc as (select vec_id, label, case when mse <= 0 then 100 else 10 * log10(65025 / mse) end as psnr, (2 * ma * mb + 6.5025) * (2 * cab + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225)) as ssim from mo)"""


def quantised_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fidelity.frame_scores(pixels(spark, sf_dir).withColumn("b", X.quantize(F.col("a"), 32)), ["vec_id", "label"])


@query(f"with {SCORES} select vec_id, round(psnr, 6) as psnr, round(ssim, 6) as ssim from sc")
def frame_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames against their quantised form"""
    return quantised_scores(spark, sf_dir).select("vec_id", F.round("psnr", 6).alias("psnr"), F.round("ssim", 6).alias("ssim"))


@query(f"with {SCORES} select label, count(*) as frames, round(avg(psnr), 6) as psnr, round(avg(ssim), 6) as ssim from sc group by 1")
def mean_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7"""
    m = fidelity.mean_scores(quantised_scores(spark, sf_dir), ["label"])
    return m.select("label", "frames", F.round("psnr", 6).alias("psnr"), F.round("ssim", 6).alias("ssim"))


MS = "epoch_us({0}) // 1000"


def days(column: str) -> F.Column:
    return F.floor(F.unix_micros(F.col(column).cast("timestamp")) / (1000 * DAY)).cast("double")


@query(f"""select lower(o_orderpriority) as path, l_suppkey, min(l_orderkey) as first, count(*) as members, min(coalesce(case when l_returnflag = 'N' then null else {MS.format('l_shipdate')} // {DAY} end, 0))::double as union_start,
max(coalesce(case when l_returnflag = 'A' then null else {MS.format('l_shipdate')} // {DAY} + l_quantity end, 20000.0))::double as union_end
from lineitem join orders on l_orderkey = o_orderkey group by 1, 2""")
def source_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of a source (priority, supplier) with open starts and ends"""
    return sources.plan_sources(*source_members(spark, sf_dir), SOURCE, "l_orderkey")


SOURCE = ["path", "l_suppkey"]
PLANS = f"""with mb as (select lower(o_orderpriority) as path, l_suppkey, l_orderkey, case when l_returnflag = 'N' then 0 else {MS.format('l_shipdate')} // {DAY} end as s, case when l_returnflag = 'A' then 20000.0 else {MS.format('l_shipdate')} // {DAY} + l_quantity end as e from lineitem join orders on l_orderkey = o_orderkey),
pl as (select path, l_suppkey, min(s)::double as union_start, max(e)::double as union_end from mb group by 1, 2)"""


@query(f"{PLANS} select l_orderkey, path, l_suppkey, union_start, union_end from mb join pl using (path, l_suppkey)")
def planned_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of a source with the window to decode for it"""
    members, media = source_members(spark, sf_dir)
    out = sources.assign_members(members, sources.plan_sources(members, media, SOURCE, "l_orderkey"), SOURCE)
    return out.select("l_orderkey", *SOURCE, "union_start", "union_end")


@query(f'{PLANS} select distinct s::double as start, e::double as "end" from mb')
def decode_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of all uses, each once"""
    members, _ = source_members(spark, sf_dir)
    return sources.distinct_windows(members.select(F.coalesce("start", F.lit(0.0)).alias("start"), F.coalesce("end", F.lit(20000.0)).alias("end")))


def source_members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The uses of the sources, and the length of each source."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_shipdate", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    m = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        X.source_key(F.col("o_orderpriority"), F.lit(None).cast("double"), F.lit(30.0))["path"].alias("path"), "l_suppkey", "l_orderkey",
        F.when(F.col("l_returnflag") != "N", days("l_shipdate")).alias("start"), F.when(F.col("l_returnflag") != "A", days("l_shipdate") + F.col("l_quantity")).alias("end"),
    )
    media = m.select("path", "l_suppkey").distinct().withColumn("duration", F.lit(20000.0))
    return m, media


COMMANDS = f"""cm as (select l_orderkey as object, l_returnflag as kind, ((l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey) * 100 + l_quantity::bigint as seq, {MS.format('l_shipdate')} // {DAY}::double as start, ({MS.format('l_shipdate')} // {DAY}) + l_quantity as "end", l_linenumber % 35 as easing, l_discount as v_start, l_tax as v_end from lineitem)"""


def line_order() -> F.Column:
    """The order of an order's line items; their numbers repeat."""
    return ((F.col("l_linenumber").cast("long") * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("long")


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as commands of their order: kind, a span of days, an easing, and values."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("object"), F.col("l_returnflag").alias("kind"), line_order().alias("seq"), days("l_shipdate").alias("start"),
        (days("l_shipdate") + F.col("l_quantity")).alias("end"), (F.col("l_linenumber") % 35).alias("easing"), F.col("l_discount").alias("v_start"), F.col("l_tax").alias("v_end"),
    )


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("object"), days("o_orderdate").alias("d"))
    at = o.select("object", F.explode(F.transform(F.array(F.lit(20), F.lit(60), F.lit(100)), lambda k: F.col("d") + k)).alias("t"))
    return commands(spark, sf_dir).select("object", "kind").distinct().join(at, "object")


MOMENTS = f"""mm as (select distinct object, kind, {MS.format('o_orderdate')} // {DAY} + k as t from cm join orders on object = o_orderkey, (values (20), (60), (100)) v(k))"""
CURVE = """case easing when 1 then 1 - (1 - p) * (1 - p) when 2 then p * p when 3 then p * p when 4 then 1 - (1 - p) * (1 - p) when 5 then case when p < 0.5 then 2 * p * p else 1 - power(-2 * p + 2, 2) / 2 end when 6 then power(p, 3) when 7 then 1 - power(1 - p, 3) else p end"""


@query(f"""with {COMMANDS}, {MOMENTS},
j as (select mm.object, mm.kind, t, count(*) filter (start <= t and t <= "end") as na, arg_min(start, seq) as fs, arg_min(v_start, seq) as fv,
 max(seq) filter (start <= t and t <= "end") as sa, arg_max(v_end, {{'e': "end", 's': seq}}) as lv from mm join cm on mm.object = cm.object and mm.kind = cm.kind group by 1, 2, 3),
v as (select j.*, cm.easing, cm.v_start as a, cm.v_end as b, case when cm."end" - cm.start <= 1e-9 then 1 else (t - cm.start) / (cm."end" - cm.start) end as p from j left join cm on j.object = cm.object and j.kind = cm.kind and j.sa = cm.seq)
select object, kind, t::double as t, round(case when na > 0 then a + (b - a) * ({CURVE}) when t < fs then fv else lv end, 9) as value from v""")
def timeline_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1, W15, J6"""
    return timeline.evaluate(commands(spark, sf_dir), moments(spark, sf_dir)).withColumn("value", F.round("value", 9))


@query(f"""with {COMMANDS}, {MOMENTS} select mm.object, mm.kind, t::double as t, bool_or(case when "end" - start <= 1e-9 then start <= t else start <= t and t < "end" end) as flag from mm join cm on mm.object = cm.object and mm.kind = cm.kind group by 1, 2, 3""")
def timeline_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3"""
    return timeline.flag_at(commands(spark, sf_dir), moments(spark, sf_dir))


@query(f"""with {COMMANDS} select object, min(start) as start, max("end") as "end" from cm group by 1 having max("end") - min(start) >= 60""")
def object_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, F2"""
    return timeline.lifetimes(commands(spark, sf_dir)).where("end - start >= 60")


@query(f'with {COMMANDS} select coalesce(max("end"), 0)::double as duration from cm')
def story_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of the last order's lifetime"""
    return timeline.duration(timeline.lifetimes(commands(spark, sf_dir)))


@query(f"""with {COMMANDS}, lt as (select object, min(start) as start, max("end") as "end" from cm group by 1),
o as (select o_orderkey as object, ({MS.format('o_orderdate')} // {DAY} + o_custkey % 200)::double as t from orders)
select object, start, "end", t from lt join o using (object) where start <= t and t <= "end" """)
def alive_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders that are under way some days, up to 200, after their date"""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("object"), (days("o_orderdate") + F.col("o_custkey") % 200).alias("t"))
    return timeline.alive(timeline.lifetimes(commands(spark, sf_dir)).join(o, "object"), F.col("t")).select("object", "start", "end", "t")


@query(f"""with x as (select l_orderkey, l_linenumber, l_linenumber % 8 as easing, l_discount * 10 as p from lineitem) select l_orderkey, l_linenumber, easing, round({CURVE}, 9) as eased from x""")
def eased_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Easing curves"""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 8).alias("easing"), (F.col("l_discount") * 10).alias("p"))
    return l.select("l_orderkey", "l_linenumber", "easing", F.round(ease(F.col("easing"), F.col("p")), 9).alias("eased"))


def _bounce_sql(t: str) -> str:
    return f"case when {t} < 1 / 2.75 then 7.5625 * {t} * {t} when {t} < 2 / 2.75 then 7.5625 * ({t} - 1.5 / 2.75) * ({t} - 1.5 / 2.75) + 0.75 when {t} < 2.5 / 2.75 then 7.5625 * ({t} - 2.25 / 2.75) * ({t} - 2.25 / 2.75) + 0.9375 else 7.5625 * ({t} - 2.625 / 2.75) * ({t} - 2.625 / 2.75) + 0.984375 end"


def _power_sql(first: int, n: int) -> str:
    return f"when {first} then power(p, {n}) when {first + 1} then 1 - power(1 - p, {n}) when {first + 2} then case when p < 0.5 then {2 ** (n - 1)} * power(p, {n}) else 1 - power(-2 * p + 2, {n}) / 2 end"


ENDS_SQL = "case when abs(p) <= 1e-9 then 0.0 when abs(p - 1) <= 1e-9 then 1.0 else {} end"
SWING_SQL = "{} * power(2.0, -10 * p) * sin((10 * p - 0.75) * 2 * pi() / 3) + 1"
WAVE_SQL = "sin((20 * p - 11.125) * 2 * pi() / 4.5)"
ALL_CURVES = f"""case easing when 1 then 1 - (1 - p) * (1 - p) when 2 then p * p when 3 then p * p when 4 then 1 - (1 - p) * (1 - p) when 5 then case when p < 0.5 then 2 * p * p else 1 - power(-2 * p + 2, 2) / 2 end
{_power_sql(6, 3)} {_power_sql(9, 4)} {_power_sql(12, 5)} when 15 then 1 - cos(p * pi() / 2) when 16 then sin(p * pi() / 2) when 17 then -(cos(p * pi()) - 1) / 2
when 18 then case when abs(p) <= 1e-9 then 0.0 else power(2.0, 10 * p - 10) end when 19 then case when abs(p - 1) <= 1e-9 then 1.0 else 1 - power(2.0, -10 * p) end
when 20 then {ENDS_SQL.format("case when p < 0.5 then power(2.0, 20 * p - 10) / 2 else (2 - power(2.0, -20 * p + 10)) / 2 end")}
when 21 then 1 - sqrt(greatest(1 - p * p, 0)) when 22 then sqrt(greatest(1 - (p - 1) * (p - 1), 0)) when 23 then case when p < 0.5 then (1 - sqrt(greatest(1 - 4 * p * p, 0))) / 2 else (sqrt(greatest(1 - (-2 * p + 2) * (-2 * p + 2), 0)) + 1) / 2 end
when 24 then {ENDS_SQL.format("-power(2.0, 10 * p - 10) * sin((10 * p - 10.75) * 2 * pi() / 3)")} when 25 then {ENDS_SQL.format(SWING_SQL.format(1.0))} when 26 then {ENDS_SQL.format(SWING_SQL.format(0.5))} when 27 then {ENDS_SQL.format(SWING_SQL.format(0.25))}
when 28 then {ENDS_SQL.format(f"case when p < 0.5 then -(power(2.0, 20 * p - 10) * {WAVE_SQL}) / 2 else power(2.0, -20 * p + 10) * {WAVE_SQL} / 2 + 1 end")}
when 29 then 2.70158 * p * p * p - 1.70158 * p * p when 30 then 1 + 2.70158 * (p - 1) * (p - 1) * (p - 1) + 1.70158 * (p - 1) * (p - 1)
when 31 then case when p < 0.5 then 4 * p * p * (3.5949095 * 2 * p - 2.5949095) / 2 else ((2 * p - 2) * (2 * p - 2) * (3.5949095 * (2 * p - 2) + 2.5949095) + 2) / 2 end
when 32 then 1 - ({_bounce_sql("(1 - p)")}) when 33 then {_bounce_sql("p")} when 34 then case when p < 0.5 then (1 - ({_bounce_sql("(1 - 2 * p)")})) / 2 else (1 + ({_bounce_sql("(2 * p - 1)")})) / 2 end else p end"""


@query(f"""with x as (select l_partkey % 36 as easing, round(l_quantity / 50, 2) as p from lineitem), y as (select distinct easing, p from x) select easing, p, round({ALL_CURVES}, 7) + 0.0::double as eased from y""")
def all_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every easing curve, and one more number, which is linear"""
    l = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 36).alias("easing"), F.round(F.col("l_quantity") / 50, 2).alias("p")).distinct()
    return l.select("easing", "p", (F.round(ease(F.col("easing"), F.col("p")), 7) + 0.0).alias("eased"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, abs(l_discount - l_tax) <= 0.01 + 1e-12 as near from lineitem""")
def near_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8"""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", X.near(F.col("l_discount"), F.col("l_tax"), 0.01 + 1e-12).alias("near"))


FLAT = f"""{COMMANDS}, fl as (select object, kind, seq, start, "end", easing, round(v_start, 1) as v_start, round(v_start, 1) as v_end from cm)"""


def flat_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.round("v_start", 1)
    return commands(spark, sf_dir).withColumns({"v_start": value, "v_end": value})


@query(f"""with {FLAT} select object, kind, seq, start, "end", v_start from fl l where not exists (select 1 from fl r where r.object = l.object and r.kind = l.kind and r.seq <> l.seq
and abs(r.v_start - l.v_start) <= 1e-4 and r.start <= l.start and r."end" >= l."end" and (r.start < l.start or r."end" > l."end" or r.seq < l.seq))""")
def covered_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7, I3"""
    return rewrite.drop_covered(flat_commands(spark, sf_dir)).select("object", "kind", "seq", "start", "end", "v_start")


@query("""with l as (select l_orderkey as object, ((l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey) * 100 + l_quantity::bigint as seq, l_quantity as q, case when l_returnflag = 'N' then 1 else 2 end as tenths from lineitem),
c as (select *, sum(q) over w as e, sum(q * tenths) over w / 10 as b, lag(tenths) over w is distinct from tenths as opens from l window w as (partition by object order by seq)),
g as (select *, sum(opens::int) over (partition by object order by seq) as run from c)
select object, 'F' as kind, min(seq) as seq, min(e - q)::double as start, max(e)::double as "end", 0 as easing, round(min(b - q * tenths / 10), 6) as v_start, round(max(b), 6) as v_end from g group by object, run""")
def merged_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's line items laid end to end, rising by a tenth of their quantity"""
    from pyspark.sql import Window

    by = Window.partitionBy("object").orderBy("seq")
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("object"), F.lit("F").alias("kind"), line_order().alias("seq"), "l_quantity", F.when(F.col("l_returnflag") == "N", 0.1).otherwise(0.2).alias("slope"))
    ends = F.sum("l_quantity").over(by)
    rises = F.sum(F.col("l_quantity") * F.col("slope")).over(by)
    merged = rewrite.merge_adjacent(l.select("object", "kind", "seq", (ends - F.col("l_quantity")).alias("start"), ends.alias("end"), F.lit(0).alias("easing"), (rises - F.col("l_quantity") * F.col("slope")).alias("v_start"), rises.alias("v_end")))
    return merged.withColumns({c: F.round(c, 6) for c in ("v_start", "v_end")})


@query("""with s as (select conv_id, count(*) as n, list(coalesce(role, '') order by turn) as r, list(turn order by turn) as k from conversations group by 1),
p as (select s.conv_id, n, period from s, range(1, 400) q(period) where n % period = 0 and n // period >= 3
 and list_aggregate(list_transform(range(period, n), lambda j: case when r[j + 1] = r[j - period + 1] and k[j + 1] - k[j - period + 1] = k[period + 1] - k[1] then 0 else 1 end), 'sum') = 0)
select s.conv_id, s.n::int as n, min(period)::int as period, (s.n // min(period))::int as count from s left join p on s.conv_id = p.conv_id group by s.conv_id, s.n""")
def role_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose roles repeat"""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"))
    return rewrite.loop_periods(c, ["conv_id"], "turn", "role").select("conv_id", "n", "period", "count")


@query("""with s as (select conv_id, count(*) as n, list(coalesce(role, '') order by turn, coalesce(role, '')) as r, list(turn order by turn, coalesce(role, '')) as k from conversations group by 1),
p as (select s.conv_id, min(period) as period from s, range(1, 400) q(period) where n % period = 0 and n // period >= 3
 and list_aggregate(list_transform(range(period, n), lambda j: case when r[j + 1] = r[j - period + 1] and k[j + 1] - k[j - period + 1] = k[period + 1] - k[1] then 0 else 1 end), 'sum') = 0 group by 1),
x as (select s.conv_id, n, period, k[1] as t0, unnest(range(n)) as i, unnest(r) as role, unnest(k) as turn from s left join p on s.conv_id = p.conv_id)
select conv_id, i::int as i, case when period is null then turn else turn - t0 end as turn, role, period::int as period, (n // period)::int as count from x where period is null or i < period""")
def loop_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4, T4: conversations, those that repeat as a loop's body"""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"))
    return rewrite.apply_loops(c, ["conv_id"], "turn", "role").select("conv_id", "i", "turn", "role", "period", "count")


@query(f"""with lo as (select o_orderkey as object, {MS.format('o_orderdate')} // {DAY}::double as base, o_orderkey % 4 as c from orders),
ch as (select l_orderkey as object, ((l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey) * 100 + l_quantity::bigint as seq, l_linenumber::double as start, l_linenumber + l_quantity as "end" from lineitem),
cy as (select object, greatest(0, max("end")) as cycle from ch group by 1)
select object, i::int as i, seq, start + base + i * cycle as start, "end" + base + i * cycle as "end" from lo join cy using (object) join ch using (object), lateral (select unnest(range(0, greatest(c - 1, 0) + 1)) as i)""")
def flattened_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as loops over their line items"""
    loops = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("object"), F.lit(0).alias("loop"), days("o_orderdate").alias("start"), (F.col("o_orderkey") % 4).alias("count"))
    line = F.col("l_linenumber").cast("double")
    children = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("object"), F.lit(0).alias("loop"), line_order().alias("seq"), line.alias("start"), (line + F.col("l_quantity")).alias("end"))
    return rewrite.flatten_loops(loops, children).select("object", F.col("i").cast("int").alias("i"), "seq", "start", "end")


@query(f"""with lf as (select o_custkey as object, o_orderkey as o, ascii(l_returnflag) % 4 + 1 as f, -(((l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey) * 100 + l_quantity::bigint) as seq, l_linenumber::double as start, l_linenumber + l_quantity as "end",
 {MS.format('o_orderdate')} // {DAY}::double as base, greatest(o_orderkey % 3, 1) as n from lineitem join orders on l_orderkey = o_orderkey),
ci as (select o, f, max("end") as cycle, 2 * f + (f - 1) * max("end") + max("end") as upto from lf group by 1, 2), co as (select o, max(upto) as outer_cycle from ci group by 1)
select object, seq, i as iteration, start + base + 2 * f + i % f * cycle + i // f * outer_cycle as start, "end" + base + 2 * f + i % f * cycle + i // f * outer_cycle as "end"
from lf join ci using (o, f) join co using (o), lateral (select unnest(range(0, n * f)) as i)""")
def nested_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as loops over loops (line items of one flag) over line items"""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    none = F.lit(None)
    flag = F.ascii("l_returnflag") % 4 + 1
    line = F.col("l_linenumber").cast("double")
    both = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("inner", F.col("o_orderkey") * 8 + flag)
    outer = o.select(F.col("o_custkey").alias("object"), (F.col("o_orderkey") * 8).alias("seq"), F.lit(-1).cast("long").alias("parent"), F.lit(1).alias("depth"), F.lit("Loop").alias("kind"), days("o_orderdate").alias("start"), none.cast("double").alias("end"), (F.col("o_orderkey") % 3).cast("int").alias("count"))
    inner = both.select(F.col("o_custkey").alias("object"), F.col("inner").alias("seq"), (F.col("o_orderkey") * 8).alias("parent"), F.lit(2).alias("depth"), F.lit("Loop").alias("kind"), (2.0 * flag).alias("start"), none.cast("double").alias("end"), flag.cast("int").alias("count")).distinct()
    leaves = both.select(F.col("o_custkey").alias("object"), (-line_order()).alias("seq"), F.col("inner").alias("parent"), F.lit(3).alias("depth"), F.lit("Fade").alias("kind"), line.alias("start"), (line + F.col("l_quantity")).alias("end"), none.cast("int").alias("count"))
    return rewrite.expand_loops(outer.unionByName(inner).unionByName(leaves)).select("object", "seq", "iteration", "start", "end")


@query(f"""with {COMMANDS}, x as (select object, kind, start, "end", easing, seq, row_number() over (partition by object, start, "end", easing order by seq) as place from cm where kind = 'A'),
y as (select object, kind, start, "end", easing, seq, row_number() over (partition by object, start, "end", easing order by seq) as place from cm where kind = 'R')
select coalesce(x.object, y.object) as object, coalesce(x.start, y.start) as start, coalesce(x."end", y."end") as "end", coalesce(x.easing, y.easing) as easing, x.seq as x_seq, y.seq as y_seq
from x full join y on x.object = y.object and x.start = y.start and x."end" = y."end" and x.easing = y.easing and x.place = y.place""")
def paired_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8"""
    c = commands(spark, sf_dir)
    return rewrite.pair_axes(c.where("kind = 'A'"), c.where("kind = 'R'"), ["object"])


BAKED = f"""{COMMANDS}, lf as (select object, min(start) as s, max("end") as e from cm group by 1),
sm as (select object, t from lf, lateral (select unnest(list_distinct(list_append(list_transform(range(0, greatest(ceil((e - s) / 30)::int, 1)), lambda k: s + k * 30.0), e))) as t))"""


@query(f"""with {BAKED}, f as (select sm.object, t, bool_or(start <= t and t < "end") as flag from sm join cm on sm.object = cm.object group by 1, 2),
c as (select *, coalesce(lag(flag) over (partition by object order by t) <> flag, true) as c from f),
w as (select object, t, flag, lead(t) over (partition by object order by t) as e from c where c)
select w.object, t as start, coalesce(e, (select max(t) from f where f.object = w.object)) as "end" from w where flag""")
def flag_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When an order has an item under way, sampled every 30 days"""
    return bake.flags_under_way(commands(spark, sf_dir), ["object"], 30.0, 64 * 30.0)


@query(f"""with {BAKED}, f as (select sm.object, t, count(*) filter (start <= t and t < "end")::double as value from sm join cm on sm.object = cm.object group by 1, 2),
c as (select *, lead(t) over w as t1, lead(value) over w as v1, max(value) over p - min(value) over p <= 1e-6 as constant, max(t) over p as tz, row_number() over w as k from f window w as (partition by object order by t), p as (partition by object))
select object, t as start, t1 as "end", value as v_start, v1 as v_end from c where not constant and t1 is not null union all select object, t, tz, value, value from c where constant and k = 1""")
def baked_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of items under way as linear segments"""
    return bake.under_way(commands(spark, sf_dir), ["object"], 30.0, 64 * 30.0)


SCRIPTS = f"""cm as (select l_orderkey as object, case l_linenumber when 1 then 'MoveX' when 2 then 'MoveY' when 3 then 'VectorScaleX' when 4 then 'Rotate' when 5 then 'Fade' when 6 then 'Colour' else case when l_returnflag = 'A' then 'Additive' else 'FlipH' end end as kind,
 ((l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey) * 100 + l_quantity::bigint as seq, ({MS.format('l_shipdate')} // {DAY})::double as start, ({MS.format('l_shipdate')} // {DAY}) + l_quantity as "end", l_discount * 10 as a, l_tax * 10 as b from lineitem),
ru as (select o_orderkey as object, k as run, (o_custkey % 640)::double as x, (o_orderkey % 480)::double as y, ({MS.format('o_orderdate')} // {DAY})::double + 10 + 30 * k as start, ({MS.format('o_orderdate')} // {DAY})::double + 40 + 60 * k as "end" from orders, (values (0), (1)) v(k)),
ev as (select object, kind, unnest([start, "end"]) as t from cm where kind <> 'x'),
sn as (select distinct ru.object, run, ru.start, t from ru join ev on ru.object = ev.object and ru.start < t and t < ru."end" union select object, run, start, "end" from ru),
sp as (select object, run, ru.start, "end", i as k, ceil(("end" - ru.start) / 7)::int as n, case when i = ceil(("end" - ru.start) / 7)::int then "end" else ru.start + i * 7.0 end as t from ru, range(0, 10) r(i) where i <= ceil(("end" - ru.start) / 7)::int),
mm as (select object, t from sn union select object, start from ru union select object, t from sp),
jj as (select mm.object, kind, t, arg_min(start, seq) as fs, arg_min(a, seq) as fv, max(seq) filter (start <= t and t <= "end") as sa, arg_max(b, {{'e': "end", 's': seq}}) as lv, bool_or(start <= t and t < "end") as flag from mm join cm on mm.object = cm.object group by 1, 2, 3),
va as (select jj.*, case when cm.seq is not null then cm.a + (cm.b - cm.a) * case when cm."end" - cm.start <= 1e-9 then 1 else (t - cm.start) / (cm."end" - cm.start) end when t < fs then fv else lv end as v,
  case when cm.seq is not null then cm.a * 200 + (cm.b * 200 - cm.a * 200) * case when cm."end" - cm.start <= 1e-9 then 1 else (t - cm.start) / (cm."end" - cm.start) end when t < fs then fv * 200 else lv * 200 end as c from jj left join cm on jj.object = cm.object and jj.kind = cm.kind and jj.sa = cm.seq),
st as (select mm.object, mm.t, coalesce(max(v) filter (kind = 'MoveX'), 320) as mx, coalesce(max(v) filter (kind = 'MoveY'), 240) as my, coalesce(max(v) filter (kind = 'VectorScaleX'), 1) as vx, coalesce(max(v) filter (kind = 'Rotate'), 0) as an, coalesce(max(v) filter (kind = 'Fade'), 1) as fa,
  coalesce(max(trunc(c)) filter (kind = 'Colour'), 255)::int as co, coalesce(bool_or(flag) filter (kind = 'FlipH'), false) as fh, coalesce(bool_or(flag) filter (kind = 'Additive'), false) as ad from mm left join va on mm.object = va.object and mm.t = va.t group by 1, 2),
ke as (select sn.object, sn.run, bool_and(abs(p.mx - q.mx) <= 1e-6 and abs(p.my - q.my) <= 1e-6 and abs(p.vx - q.vx) <= 1e-6 and abs(p.an - q.an) <= 1e-6 and p.fh = q.fh) as kp, bool_and(abs(p.fa - q.fa) <= 1e-6) as kf, bool_and(p.co = q.co) as kc, bool_and(p.ad = q.ad) as ka, bool_and(p.fh = q.fh) as kh
  from sn join st p on sn.object = p.object and sn.start = p.t join st q on sn.object = q.object and sn.t = q.t group by 1, 2),
po as (select ru.object, ru.run, st.t, st.*, mx + (x - 320) * vx * case when fh then -1.0 else 1.0 end * cos(an) - (y - 240) * sin(an) as px, my + (x - 320) * vx * case when fh then -1.0 else 1.0 end * sin(an) + (y - 240) * cos(an) as py, 0.5 * vx as sx, 0.5::double as sy, case when fa > 1 then fa % 1 else fa end as al from ru join st on ru.object = st.object),
p0 as (select ru.start, ru."end", po.*, kp, kf, kc, ka, kh from ru join po on ru.object = po.object and ru.run = po.run and ru.start = po.t join ke on ke.object = ru.object and ke.run = ru.run),
se as (select a.object, a.run, a.start, b.start as "end", a.p, b.p as q from (select sp.object, sp.run, k, sp.t as start, n, po as p from sp join po on po.object = sp.object and po.run = sp.run and po.t = sp.t) a join (select sp.object, sp.run, k, sp.t as start, po as p from sp join po on po.object = sp.object and po.run = sp.run and po.t = sp.t) b on a.object = b.object and a.run = b.run and b.k = a.k + 1),
fl as (select sp.object, sp.run, kind, k, sp.t, case kind when 'FlipH' then fh else ad end as flag from sp join po on po.object = sp.object and po.run = sp.run and po.t = sp.t join ke on ke.object = sp.object and ke.run = sp.run, (values ('FlipH'), ('Additive')) v(kind) where case kind when 'FlipH' then not kh else not ka end),
fg as (select *, k - row_number() over (partition by object, run, kind, flag order by k) as g from fl),
fw as (select object, run, kind, min(t) as start, max(k) as z from fg where flag group by object, run, kind, g),
fe as (select fw.object, fw.run, fw.kind, fw.start, coalesce(fl.t, (select max(t) from fl z where z.object = fw.object and z.run = fw.run and z.kind = fw.kind)) as "end" from fw left join fl on fl.object = fw.object and fl.run = fw.run and fl.kind = fw.kind and fl.k = fw.z + 1),
pc as (select object, run, 'MoveX' as kind, start, "end", px as v_start, px as v_end, null::int as c_start, null::int as c_end from p0 where kp union all select object, run, 'MoveY', start, "end", py, py, null, null from p0 where kp
 union all select object, run, 'VectorScaleX', start, "end", sx, sx, null, null from p0 where kp union all select object, run, 'VectorScaleY', start, "end", sy, sy, null, null from p0 where kp
 union all select object, run, 'Rotate', start, "end", an, an, null, null from p0 where kp and abs(an) > 1e-6 union all select object, run, 'Fade', start, "end", al, al, null, null from p0 where kf and abs(al - 1) > 1e-4
 union all select object, run, 'Colour', start, "end", null, null, co, co from p0 where kc and co <> 255 union all select object, run, 'FlipH', start, "end", null, null, null, null from p0 where kh and fh union all select object, run, 'Additive', start, "end", null, null, null, null from p0 where ka and ad
 union all select se.object, se.run, 'MoveX', se.start, se."end", p.px, q.px, null, null from se join ke using (object, run) where not kp union all select se.object, se.run, 'MoveY', se.start, se."end", p.py, q.py, null, null from se join ke using (object, run) where not kp
 union all select se.object, se.run, 'VectorScaleX', se.start, se."end", p.sx, q.sx, null, null from se join ke using (object, run) where not kp union all select se.object, se.run, 'VectorScaleY', se.start, se."end", p.sy, q.sy, null, null from se join ke using (object, run) where not kp
 union all select se.object, se.run, 'Rotate', se.start, se."end", p.an, q.an, null, null from se join ke using (object, run) where not kp union all select se.object, se.run, 'Fade', se.start, se."end", p.al, q.al, null, null from se join ke using (object, run) where not kf
 union all select se.object, se.run, 'Colour', se.start, se."end", null, null, p.co, q.co from se join ke using (object, run) where not kc union all select object, run, kind, start, "end", null, null, null, null from fe where "end" > start)"""


@query(f"""with {SCRIPTS} select object, run::int as run, kind, start, "end", round(v_start, 6) + 0.0::double as v_start, round(v_end, 6) + 0.0::double as v_end, c_start, c_end from pc""")
def baked_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as groups that their line items move, scale, turn, fade, colour and flip, with two runs each"""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    names = F.array(*map(F.lit, ("MoveX", "MoveY", "VectorScaleX", "Rotate", "Fade", "Colour")))
    kind = F.coalesce(F.get(names, F.col("l_linenumber") - 1), F.when(F.col("l_returnflag") == "A", "Additive").otherwise("FlipH"))
    grey = lambda c: F.struct(*[(F.col(c) * 10 * 200).alias(x) for x in "rgb"])
    script = l.select(
        F.col("l_orderkey").alias("object"), line_order().alias("seq"), F.lit(None).cast("long").alias("parent"), kind.alias("kind"), days("l_shipdate").alias("start"), (days("l_shipdate") + F.col("l_quantity")).alias("end"),
        F.lit(0).alias("easing"), (F.col("l_discount") * 10).alias("v_start"), (F.col("l_tax") * 10).alias("v_end"), grey("l_discount").alias("c_start"), grey("l_tax").alias("c_end"), F.lit(None).cast("string").alias("trigger"),
    )
    pivots = o.select(F.col("o_orderkey").alias("object"), F.lit(320.0).alias("px"), F.lit(240.0).alias("py"))
    runs_ = o.select(
        F.col("o_orderkey").alias("object"), (F.col("o_custkey") % 640).cast("double").alias("x"), (F.col("o_orderkey") % 480).cast("double").alias("y"), F.lit(0.5).alias("scale"), days("o_orderdate").alias("d"), F.explode(F.array(F.lit(0), F.lit(1))).alias("run"),
    ).withColumns({"start": F.expr("d + 10 + 30 * run"), "end": F.expr("d + 40 + 60 * run")}).drop("d")
    baked = bake.bake_runs(script, pivots, runs_, 7.0)
    return baked.select("object", "run", "kind", "start", "end", *[(F.round(c, 6) + 0.0).alias(c) for c in ("v_start", "v_end")], F.col("c_start.r").alias("c_start"), F.col("c_end.r").alias("c_end"))


@query(f"""with l as (select l_orderkey as object, (((l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey) * 100 + l_quantity::bigint) * 32 as s0, l_linenumber::double as a, l_quantity as b, l_suppkey % 5 + 1 as reps, ({MS.format('l_shipdate')} // {DAY})::double as d, l_discount as x, l_tax as y,
 case when l_linenumber % 2 = 1 then 'Fade' else 'Scale' end as kind, case when l_linenumber = l_quantity and l_discount = l_tax and l_suppkey % 5 >= 1 then 1 when l_suppkey % 5 >= 2 then 2 end as p from lineitem)
select object, s0::double as seq, 'Additive' as kind, d as start, d as "end", null::double as v_start, null::double as v_end, null::double as parent, null::int as count from l
union all select object, s0 + 0.75::double, 'Loop', d, d, null, null, null, (2 * reps // p)::int from l where p is not null
union all select object, (s0 + 1 + i)::double, kind, case when p is null then d else 0 end + i // 2 * (a + b) + i % 2 * a, case when p is null then d else 0 end + i // 2 * (a + b) + i % 2 * a + case when i % 2 = 0 then a else b end,
 case when i % 2 = 0 then x else y end, case when i % 2 = 0 then y else x end, case when p is not null then s0 + 0.75::double end, null from l, range(0, 10) r(i) where i < 2 * reps and (p is null or i < p)""")
def command_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's line items as values that go up and down, some of them again and again"""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("object"), (line_order() * 32).alias("seq"), "l_linenumber", "l_quantity", "l_suppkey", "l_shipdate", "l_discount", "l_tax")

    def unpack(rows: DataFrame) -> DataFrame:
        """A flag, and up to ten values after it."""
        named = rows.select(
            "object", F.col("seq").alias("s0"), F.col("l_linenumber").cast("double").alias("a"), F.col("l_quantity").alias("b"), (F.col("l_suppkey") % 5 + 1).cast("int").alias("reps"),
            days("l_shipdate").alias("d"), F.col("l_discount").alias("x"), F.col("l_tax").alias("y"), F.when(F.col("l_linenumber") % 2 == 1, "Fade").otherwise("Scale").alias("kind"),
        )
        each = named.withColumn("i", F.explode(F.expr("sequence(-1, greatest(2 * reps - 1, -1))")))
        flag, up = F.col("i") < 0, F.col("i") % 2 == 0
        each = each.withColumn("start", F.when(flag, F.col("d")).otherwise(F.expr("d + i div 2 * (a + b) + i % 2 * a")))
        return each.select(
            "object", (F.col("s0") + 1 + F.col("i")).alias("seq"), F.when(flag, "Additive").otherwise(F.col("kind")).alias("kind"), "start",
            F.when(flag, F.col("d")).otherwise(F.col("start") + F.when(up, F.col("a")).otherwise(F.col("b"))).alias("end"), F.lit(0).alias("easing"),
            F.when(~flag, F.when(up, F.col("x")).otherwise(F.col("y"))).alias("v_start"), F.when(~flag, F.when(up, F.col("y")).otherwise(F.col("x"))).alias("v_end"),
        )

    return loops.extract_command_loops(l, unpack=unpack).select("object", "seq", "kind", "start", "end", "v_start", "v_end", "parent", "count")


@query("""with tg as (select n_regionkey, n_nationkey, 1.0 + n_nationkey / 10.0 as scale, n_nationkey * 2.0 as dx, n_nationkey * -1.0 as dy from nation),
r as (select c_custkey, n_regionkey, c_acctbal as x, c_custkey * 1.0 as y from customer join nation on c_nationkey = n_nationkey)
select c_custkey, n_nationkey, round(x * scale + dx, 6) as px, round(y * scale + dy, 6) as py from r join tg using (n_regionkey)""")
def placed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer at every nation of its region"""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    runs_ = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_regionkey", F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 1.0).alias("y"))
    key = F.col("n_nationkey")
    targets = n.select("n_nationkey", "n_regionkey", (1.0 + key / 10.0).alias("scale"), (key * 2.0).alias("dx"), (key * -1.0).alias("dy"))
    return bake.place(runs_, targets, ["n_regionkey"]).select("c_custkey", "n_nationkey", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


@query(f"""with s as (select l_orderkey, l_linenumber, ({MS.format('l_shipdate')} // {DAY})::double as start, l_quantity * 200 as duration, l_linenumber = 1 as is_first from lineitem),
w as (select *, case when is_first then start + (duration - 3000) / 2 else start end as base from s)
select l_orderkey, l_linenumber, start, start + duration as "end", fold from w, (values ('train'), ('eval')) f(fold) where duration <= 3000
union all select l_orderkey, l_linenumber, base + i * 750, base + (i + 1) * 750, case when i = 2 then 'eval' else 'train' end from w, range(4) r(i) where duration > 3000""")
def sample_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W16"""
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", days("l_shipdate").alias("start"), (F.col("l_quantity") * 200).alias("duration"), (F.col("l_linenumber") == 1).alias("is_first"))
    return tuning.sample_windows(s, ["l_orderkey", "l_linenumber"])


@query("""with c as (select l_orderkey, l_linenumber as ord, l_quantity as tr, l_quantity - l_discount * 20 as ev, l_extendedprice as bytes, l_partkey % 100 as cmds from lineitem),
p as (select *, tr >= 20 and ev >= 20 as ok, bytes + 100 * cmds as cost from c)
select l_orderkey, count(*) filter (ok) as passing, case when count(*) filter (ok) > 0 then arg_min(ord, {'c': cost, 'o': ord}) filter (ok) else arg_max(ord, {'t': tr, 'o': -ord}) end as chosen from p group by 1""")
def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3, F10"""
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("ord"), F.col("l_quantity").alias("train"), (F.col("l_quantity") - F.col("l_discount") * 20).alias("eval"), F.lit(20.0).alias("floor"), F.col("l_extendedprice").alias("bytes"), (F.col("l_partkey") % 100).alias("commands"))
    return tuning.select_best(c, ["l_orderkey"])


#: Axes for images of 8 by 8
SMALL_AXES = {"tile": (8, 4, 2), "colors": (0, 4, 2), "quant": (32, 16, 8), "tolerance": (0, 8, 16, 64)}


def sample_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames of a series (label); of four frames in a row the third is for evaluation."""
    images = grey_images(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    fold = F.when(F.col("vec_id") % 4 == 2, "eval").otherwise("train")
    return images.select(F.col("label").alias("series"), F.col("vec_id").alias("frame"), fold.alias("fold"), F.lit(8).alias("width"), F.lit(8).alias("height"), "rgb")


@query()
def probed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every axis beside the defaults, encoded, drawn and scored in one job"""
    start = tuning.Parameters(tile=8)
    tried = [start, *(replace(start, **{k: v}) for k, values in SMALL_AXES.items() for v in values if v != getattr(start, k))]
    names = spark.createDataFrame([(k, p.tile, p.colors, p.quant, p.tolerance) for k, p in enumerate(tried)], "ord long, tile int, colors int, quant int, tolerance int")
    return names.join(probes.probe(stash(sample_frames(spark, sf_dir)), tried), "ord").withColumns({c: F.round(c, 6) for c in ("train", "eval")})


@query()
def tuned_quantiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1 to H4: the axes searched one after another, each in one job over frames that are decoded once"""
    frames = stash(sample_frames(spark, sf_dir))
    best, probed = tuning.tune(lambda c: probes.scores(frames, c), tuning.Parameters(tile=8), SMALL_AXES)
    return frames.groupBy(F.col("series").cast("int").alias("label")).agg(F.count("*").alias("vectors")).select("label", "vectors", *[F.lit(getattr(best, k)).alias(k) for k in tuning.AXES], F.lit(probed).alias("probed"))


def story_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as fades of a sprite of their order."""
    null = F.lit(None)
    return commands(spark, sf_dir).select(
        F.col("object").cast("string").alias("doc"), F.lit(1).alias("object"), F.lit(1).alias("parent"), (F.col("seq") + 1).cast("double").alias("seq"), F.lit(1).alias("depth"), F.lit("Fade").alias("kind"), "easing", "start", "end",
        F.col("v_start").cast("float").alias("v_start"), F.col("v_end").cast("float").alias("v_end"), null.cast("struct<r:int,g:int,b:int>").alias("c_start"), null.cast("struct<r:int,g:int,b:int>").alias("c_end"),
        null.cast("int").alias("count"), null.cast("string").alias("trigger"), null.cast("int").alias("group"),
    )


def storyboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("doc"), F.lit(1.0).alias("seq"), F.concat_ws(",", F.lit("Sprite,Background,Centre"), F.concat(F.lit('"'), F.lower("o_orderpriority"), F.lit('.png"')), F.lit("320,240")).alias("line"))
    return storyboard.documents(header.unionByName(storyboard.command_lines(story_commands(spark, sf_dir), shorthand=True)))


@query(f"""with {COMMANDS}, t as (select object, seq, case when v_start = 0 then '0' else rtrim(format('{{:.2f}}', v_start), '0') end as a, case when v_end = 0 then '0' else rtrim(format('{{:.2f}}', v_end), '0') end as b, easing, start::bigint::varchar as s, "end"::bigint::varchar as e from cm),
l as (select object, seq + 1 as seq, ' F,' || easing || ',' || s || ',' || case when s = e then '' else e end || ',' || a || case when a = b then '' else ',' || b end as line from t
 union all select o_orderkey, 1, 'Sprite,Background,Centre,"' || lower(o_orderpriority) || '.png",320,240' from orders)
select object::varchar as doc, string_agg(line, chr(10) order by seq) || chr(10) as value from l group by 1""")
def storyboard_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as storyboards"""
    return storyboards(spark, sf_dir)


@query("select o_orderkey::varchar as doc, 1::bigint as objects, 1::bigint as read_back, true as valid from orders")
def validated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: orders written as storyboards, and as many objects read back"""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("doc"))
    return storyboard.validate(storyboards(spark, sf_dir), o).select("doc", "objects", "read_back", "valid")


@query("""select o_custkey::varchar as doc, o_orderkey as z, case when o_orderkey % 4 = 0 then 'Animation' else 'Sprite' end as type, lower(o_orderpriority) || '.png' as path, 320.0::float as x, 240.0::float as y,
 case when o_orderkey % 4 = 0 then 4 end::int as frame_count, case when o_orderkey % 4 = 0 then 50.0::double end as frame_delay from orders""")
def passed_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sprites and animations copied to the output as they are, places in single precision"""
    return document.pass_through(osb_parts(spark, sf_dir)[0]).select("doc", "z", "type", "path", "x", "y", "frame_count", "frame_delay")


@query("""select l_orderkey::varchar as doc, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) + 1.0::double as seq, 'Fade' as kind, l_linenumber % 35 as easing, round(l_discount, 4) as v_start, round(l_tax, 4) as v_end from lineitem""")
def storyboard_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written storyboards parsed again"""
    parsed = storyboard.checked(storyboard.parse(storyboard.split_lines(storyboards(spark, sf_dir))))
    c = storyboard.commands(parsed)
    return c.select("doc", "seq", "kind", "easing", F.round(F.col("v_start").cast("double"), 4).alias("v_start"), F.round(F.col("v_end").cast("double"), 4).alias("v_end"))


def osb_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A customer's orders as objects of a document, on five layers, a third of them without commands."""
    null = F.lit(None)
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doc"), F.col("o_orderkey").alias("z"), "o_orderpriority")
    layers = F.array(*map(F.lit, X.LAYERS))
    objects = o.select(
        "doc", "z", F.when(F.col("z") % 4 == 0, "Animation").otherwise("Sprite").alias("type"), layers[(F.col("z") % 5).cast("int")].alias("layer"), F.lit("Centre").alias("origin"), F.concat(F.lower("o_orderpriority"), F.lit(".png")).alias("path"),
        F.lit(320.0).alias("x"), F.lit(240.0).alias("y"), F.lit(4).alias("frame_count"), F.lit(50.0).alias("frame_delay"), F.lit("LoopForever").alias("loop_type"), *[null.cast("double").alias(c) for c in ("start", "fps", "video_start", "video_end")],
    )
    own = story_commands(spark, sf_dir).withColumn("object", F.col("doc").cast("long")).drop("doc").where("object % 3 != 0")
    return objects, own.join(o.select("doc", F.col("z").alias("object")), "object")


@query(f"""with {COMMANDS}, t as (select object, seq, case when v_start = 0 then '0' else rtrim(format('{{:.2f}}', v_start), '0') end as a, case when v_end = 0 then '0' else rtrim(format('{{:.2f}}', v_end), '0') end as b, easing, start::bigint::varchar as s, "end"::bigint::varchar as e from cm where object % 3 <> 0),
la as (select * from (values (0, 'Background'), (1, 'Fail'), (2, 'Pass'), (3, 'Foreground'), (4, 'Overlay')) v(k, layer)),
l as (select o_custkey::varchar as doc, o_orderkey % 5 as k, o_orderkey as z, seq + 1 as seq, ' F,' || easing || ',' || s || ',' || case when s = e then '' else e end || ',' || a || case when a = b then '' else ',' || b end as line from t join orders on object = o_orderkey
 union all select o_custkey::varchar, k, o_orderkey, -1, case when o_orderkey % 4 = 0 then 'Animation,' else 'Sprite,' end || layer || ',Centre,"' || lower(o_orderpriority) || '.png",320,240' || case when o_orderkey % 4 = 0 then ',4,50,LoopForever' else '' end
  from orders join la on o_orderkey % 5 = k where o_orderkey in (select object from t)
 union all select doc, k, -1, 0, '//Storyboard Layer ' || k || ' (' || layer || ')' from (select distinct o_custkey::varchar as doc from orders), la
 union all select doc, k, z, 0, line from (select distinct o_custkey::varchar as doc from orders), (values (-1, 0, '[Events]'), (-1, 1, '//Background and Video events'), (5, 0, '//Storyboard Sound Samples')) v(k, z, line))
select doc, string_agg(line, chr(10) order by k, z, seq) || chr(10) as value from l group by 1""")
def osb_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as .osb files"""
    return osb.write(*osb_parts(spark, sf_dir))


@query(f"""with {COMMANDS} select o_custkey::varchar as doc, o_orderkey % 5 as layer_ord, lower(o_orderpriority) || '.png' as path, count(distinct o_orderkey) as objects, count(*) as commands, round(sum(round(v_start, 4)), 4) as v_start
from cm join orders on object = o_orderkey where object % 3 <> 0 group by 1, 2, 3""")
def osb_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written files read again"""
    objects, c = osb.read(osb.write(*osb_parts(spark, sf_dir)))
    both = objects.select("doc", F.col("z").alias("object"), F.col("layer_ord").cast("long").alias("layer_ord"), "path").join(c, ["doc", "object"])
    return both.groupBy("doc", "layer_ord", "path").agg(F.count_distinct("object").alias("objects"), F.count("*").alias("commands"), F.round(F.sum(F.round(F.col("v_start").cast("double"), 4)), 4).alias("v_start"))


@query(f"""with k as (select o_custkey::varchar as doc, case l_linenumber when 1 then 'Fade' when 2 then 'MoveX' when 3 then 'Scale' when 4 then 'Rotate' when 5 then 'Colour' when 6 then 'FlipH' else 'VectorScaleX' end as kind, {MS.format('l_shipdate')} // {DAY} as s, l_quantity as q, round(l_discount, 4) as a, round(l_tax, 4) as b from lineitem join orders on l_orderkey = o_orderkey),
r as (select * from k union all select doc, 'VectorScaleY', s, q, a + 1, b + 1 from k where kind = 'VectorScaleX')
select doc, kind, count(*) as n, sum(s)::double as start, sum(s + q)::double as "end", round(sum(a) filter (kind not in ('Colour', 'FlipH')), 4) as v_start, round(sum(b) filter (kind not in ('Colour', 'FlipH')), 4) as v_end,
 (sum(q::int) filter (kind = 'Colour'))::bigint as r, (sum(round(b * 1000)::int) filter (kind = 'Colour'))::bigint as b from r group by 1, 2""")
def osb_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands of every kind written and read again"""
    objects, _ = osb_parts(spark, sf_dir)
    none = F.lit(None)
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    kinds = ("Fade", "MoveX", "Scale", "Rotate", "Colour", "FlipH")
    kind = F.coalesce(F.get(F.array(*map(F.lit, kinds)), F.col("l_linenumber") - 1), F.lit("VectorScaleX"))
    rgb = lambda x: F.when(F.col("l_linenumber") == 5, F.struct(F.col("l_quantity").cast("int").alias("r"), F.lit(0).alias("g"), F.round(F.col(x) * 1000).cast("int").alias("b")))
    rows = both.select(
        F.col("o_custkey").cast("string").alias("doc"), F.col("l_orderkey").alias("object"), F.col("l_orderkey").alias("parent"), (F.col("l_linenumber") * 1000 + F.col("l_quantity")).alias("seq"), F.lit(1).alias("depth"), kind.alias("kind"), F.lit(0).alias("easing"),
        days("l_shipdate").alias("start"), (days("l_shipdate") + F.col("l_quantity")).alias("end"), F.round("l_discount", 4).cast("float").alias("v_start"), F.round("l_tax", 4).cast("float").alias("v_end"), rgb("l_discount").alias("c_start"), rgb("l_tax").alias("c_end"),
        none.cast("int").alias("count"), none.cast("string").alias("trigger"), none.cast("int").alias("group"),
    )
    other = rows.where("kind = 'VectorScaleX'").withColumns({"kind": F.lit("VectorScaleY"), "seq": F.col("seq") + 0.5, "v_start": (F.col("v_start").cast("double") + 1).cast("float"), "v_end": (F.col("v_end").cast("double") + 1).cast("float")})
    _, c = osb.read(osb.write(objects, rows.unionByName(other)))
    value = lambda x: F.round(F.sum(F.round(F.col(x).cast("double"), 4)), 4).alias(x)
    return c.groupBy("doc", "kind").agg(F.count("*").alias("n"), F.sum("start").alias("start"), F.sum("end").alias("end"), value("v_start"), value("v_end"), F.sum("c_start.r").alias("r"), F.sum("c_end.b").alias("b"))


@query(f"""with {COMMANDS}, n as (select o_custkey as d, count(*) as commands from cm join orders on object = o_orderkey where object % 3 <> 0 group by 1)
select o_custkey::varchar as doc, count(*) filter (o_orderkey % 4 <> 0) as sprites, count(*) filter (o_orderkey % 4 = 0) as animations, coalesce(any_value(commands), 0) as commands from orders left join n on o_custkey = d group by 1""")
def document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A3"""
    return document.document_counts(*osb_parts(spark, sf_dir))


@query("""select o_custkey::varchar as doc, ['Background', 'Fail', 'Pass', 'Foreground', 'Overlay'][(o_orderkey % 5 + 1)::int] as layer, count(*) as objects from orders group by 1, 2""")
def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16"""
    return document.layer_counts(osb_parts(spark, sf_dir)[0])


@query(f"""with {EVENTS}, s as (select user_id, event_type as stage, sum(round(value * 100))::bigint as total, max(round(value * 100))::bigint as longest from ev group by 1, 2)
select *, round(total / sum(total) over (partition by user_id), 9) as share from s""")
def stage_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as probes of stages"""
    times = events(spark, sf_dir).select("user_id", F.col("event_type").alias("stage"), F.round(F.col("value") * 100).cast("long").alias("ms"))
    return document.stage_shares(times, ["user_id"]).withColumn("share", F.round("share", 9))


@query("""with n as (select c_custkey as doc, count(o_orderkey) as frames, coalesce(avg(case when o_orderkey % 7 = 0 then round(o_totalprice * 100)::bigint end), 0) as mean, c_nationkey + 1 as w, c_custkey % 9 + 1 as h,
 coalesce(sum(round(o_totalprice * 100)::bigint) filter (o_orderkey % 2 = 0), 0)::bigint as asset_bytes, count(*) filter (o_orderkey % 2 = 0) as assets from customer join orders on c_custkey = o_custkey group by all)
select doc, frames, w * h * 3 * frames as raw_bytes, assets, asset_bytes, trunc(mean * frames)::bigint as naive_bytes from n""")
def encode_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as frames, every seventh sampled, every second stored"""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("bytes"))
    frames = o.groupBy("doc").agg(F.count("*").alias("frames"))
    counts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), (F.col("c_nationkey") + 1).alias("width"), (F.col("c_custkey") % 9 + 1).alias("height")).join(frames, "doc")
    naive = document.naive_bytes(o.where("o_orderkey % 7 = 0").join(frames, "doc"), F.col("frames"))
    out = document.encode_statistics(counts, o.where("o_orderkey % 2 = 0").select("doc", "bytes"), naive)
    return out.select("doc", "frames", "raw_bytes", "assets", "asset_bytes", "naive_bytes")


@query("""select p_brand, to_json(struct_pack(parts := count(*), sizes := sum(p_size)::bigint, largest := max(p_size), types := count(distinct p_type)))::varchar as report from part group by 1""")
def json_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: counts of a brand's parts as a report"""
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("parts"), F.sum("p_size").alias("sizes"), F.max("p_size").alias("largest"), F.count_distinct("p_type").alias("types"))
    return document.json_report(p, ["p_brand"])


def colour_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An order's line items as linear colour commands, and three moments of it."""
    l = table(spark, sf_dir, "lineitem")
    rgb = lambda x: F.struct(F.col("l_quantity").cast("int").alias("r"), (F.col(x) * 1000).cast("int").alias("g"), (255 - F.col("l_linenumber") * 20).cast("int").alias("b"))
    start = days("l_shipdate")
    c = l.select(F.col("l_orderkey").alias("object"), F.lit("Colour").alias("kind"), line_order().alias("seq"), start.alias("start"), (start + F.col("l_quantity")).alias("end"), F.lit(0).alias("easing"), rgb("l_discount").alias("c_start"), rgb("l_tax").alias("c_end"))
    return c, moments(spark, sf_dir).select("object", "t").distinct()


COLOURS = f"""{COMMANDS}, cc as (select object, seq, start, "end", l_q as r, (v_start * 1000)::int as g0, (v_end * 1000)::int as g1, 255 - easing_n * 20 as b from (select *, ("end" - start)::int as l_q, easing as easing_n from cm)),
tt as (select o_orderkey as object, {MS.format('o_orderdate')} // {DAY} + k as t from orders, (values (20), (60), (100)) v(k)),
ends as (select object, arg_min(struct_pack(s := start, r := r, g := g0, b := b), seq) as f, arg_max(struct_pack(r := r, g := g1, b := b), ("end", seq)) as l from cc group by 1),
act as (select tt.object, t, arg_max(struct_pack(s := start, e := "end", r := r, g0 := g0, g1 := g1, b := b), seq) as a from tt join cc on tt.object = cc.object and start <= t and t <= "end" group by 1, 2),
col as (select object, t, case when a is not null then a.r when t < f.s then f.r else l.r end as r,
 case when a is not null then trunc(round(a.g0 + (a.g1 - a.g0) * case when a.e = a.s then 1.0 else (t - a.s) / (a.e - a.s) end, 9))::int when t < f.s then f.g else l.g end as g,
 case when a is not null then a.b when t < f.s then f.b else l.b end as b from tt join ends using (object) left join act using (object, t))"""


@query(f"""with {COLOURS} select object, t::double as t, r::int as r, g::int as g, b::int as b from col""")
def colour_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2"""
    return timeline.evaluate_colour(*colour_parts(spark, sf_dir), digits=9)


@query(f"""with {PIXELS} select vec_id, (i // 8 // 4)::int as "row", (i % 8 // 4)::int as col, min(4) as w, sum(b)::bigint as total from pq group by 1, 2, 3""")
def tile_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 by 8 images cut into tiles of 4"""
    px = pixels(spark, sf_dir).withColumn("b", X.quantize(F.col("a"), 32))
    col, row = F.floor(F.col("i") % 8 / 4).cast("int"), F.floor(F.floor(F.col("i") / 8) / 4).cast("int")
    return px.groupBy("vec_id", row.alias("row"), col.alias("col")).agg(F.max(X.tile_bounds(col, row, 4, 8, 8)["w"]).alias("w"), F.sum("b").alias("total"))


@query(f"""with {PIXELS}, cells as (select vec_id, y, x, (y - 1) * 8 + x - 2 as i, x between 2 and 9 and y between 1 and 8 as inside from (select distinct vec_id from px), range(10) r(y), range(12) q(x))
select cells.vec_id as frame, sha256(string_agg(case when inside then repeat(printf('%02X', a), 3) else '000000' end, '' order by y, x)) as digest
from cells left join px on inside and cells.vec_id = px.vec_id and cells.i = px.i group by 1""")
def rendered_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as grey 8 by 8 images, drawn by their centre on a frame of their own; every byte at its place"""
    images = grey_images(spark, sf_dir).select("vec_id", F.lit(8).alias("w"), F.lit(8).alias("h"), "rgb")
    centre = X.origin_fraction(F.lit("Centre"))
    objects = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("vec_id").alias("frame"), F.lit(0).alias("z"), centre["fx"].alias("ox"), centre["fy"].alias("oy"), *[F.lit(v).alias(k) for k, v in (("x", 6.0), ("y", 5.0), ("sx", 1.0), ("sy", 1.0), ("angle", 0.0), ("alpha", 1.0), ("additive", False), ("r", 255), ("g", 255), ("b", 255))]
    )
    placed = render.with_assets(objects, images, "vec_id")
    return render.render_frames(placed, 12, 10).select("frame", F.sha2(F.hex("rgb"), 256).alias("digest"))


@query()
def drawn_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers' orders as sprites with embeddings as images, which their line items move, turn, scale, fade, colour and blend; from commands to pixels by tiles"""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    objects = o.select(
        F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("object"), F.when(F.col("o_orderkey") % 5 == 0, "Animation").otherwise("Sprite").alias("type"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("1.png")).otherwise(F.concat((F.col("o_orderkey") % 400).cast("string"), F.lit(".png"))).alias("path"),
        F.get(F.array(*[F.lit(x) for x in X.ORIGINS]), (F.col("o_orderkey") % 9).cast("int")).alias("origin"), (F.col("o_custkey") % 640).cast("double").alias("x"), (F.col("o_orderkey") % 480).cast("double").alias("y"), F.col("o_orderkey").alias("z"),
        F.lit(6).alias("frame_count"), F.lit(10.0).alias("frame_delay"), F.when(F.col("o_orderkey") % 2 == 0, "LoopForever").otherwise("LoopOnce").alias("loop_type"),
    )
    kinds = F.array(*map(F.lit, ("MoveX", "Rotate", "Scale", "Fade", "Colour", "Additive")))
    kind = F.coalesce(F.get(kinds, F.col("l_linenumber") - 1), F.lit("FlipH"))
    factor = F.when(kind == "MoveX", 4000.0).when(kind == "Scale", 100.0).otherwise(10.0)
    grey = lambda c: F.struct(*[(F.col(c) * 10 * 200 + 50).alias(x) for x in "rgb"])
    script = l.select(F.col("l_orderkey").alias("object"), line_order().alias("seq"), kind.alias("kind"), days("l_shipdate").alias("start"), (days("l_shipdate") + F.col("l_quantity")).alias("end"), F.lit(0).alias("easing"), (F.col("l_discount") * factor + 0.2).alias("v_start"), (F.col("l_tax") * factor + 0.2).alias("v_end"), grey("l_discount").alias("c_start"), grey("l_tax").alias("c_end"))
    shots = o.groupBy(F.col("o_custkey").alias("doc")).agg(F.min(days("o_orderdate")).alias("d")).select("doc", "d", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"))
    moments_ = shots.select("doc", (F.col("doc") * 4 + F.col("k")).alias("frame"), (F.col("d") + F.col("k") * 40).alias("t"))
    images = grey_images(spark, sf_dir).select(F.concat(F.col("vec_id").cast("string"), F.lit(".png")).alias("path"), F.lit(8).alias("w"), F.lit(8).alias("h"), "rgb")
    tiles = render.draw_tiles(render.scene(objects, script, moments_, 64, 48), images, "path", 64, 48, 16)
    return tiles.select("frame", "col", "row", "w", "h", F.sha2(F.hex("rgb"), 256).alias("digest"))


def grey_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and the 8 by 8 pixels of an embedding, three equal bytes each."""
    grey = F.sort_array(F.collect_list(F.struct("i", "a")))
    return pixels(spark, sf_dir).groupBy("vec_id").agg(F.unhex(F.array_join(F.transform(grey, lambda p: F.repeat(F.lpad(F.hex(p["a"]), 2, "0"), F.lit(3))), "")).alias("rgb"))


def cut_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = grey_images(spark, sf_dir).select(F.lit("e").alias("source"), F.col("vec_id").alias("frame"), F.lit(0.0).alias("ts"), F.lit(8).alias("width"), F.lit(8).alias("height"), "rgb")
    return frames_.extract_tiles(frames, 4)


@query(f"""with {PIXELS} select vec_id as frame, (i % 8 // 4)::int as col, (i // 8 // 4)::int as "row", min(i % 8)::int as x, min(i // 8)::int as y, 4 as w, 4 as h,
 sha256(string_agg(repeat(printf('%02X', a), 3), '' order by i)) as digest from px group by 1, 2, 3""")
def extracted_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as images, cut into tiles of 4"""
    return cut_images(spark, sf_dir).select("frame", "col", "row", "x", "y", "w", "h", F.sha2(F.hex("rgb"), 256).alias("digest"))


DIGESTS = f"{PIXELS}, dg as (select vec_id, sha256(string_agg(repeat(printf('%02X', a), 3), '' order by i)) as digest from px group by 1)"


@query(f"with {DIGESTS} select digest, count(*) as n from dg group by 1")
def read_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames of packed files, written and read by ranges of bytes"""
    path = shared(spark, "frames")
    frames_.write_raw(grey_images(spark, sf_dir), path)
    return frames_.read_raw(spark, path, 8, 8, 25.0).groupBy(F.sha2(F.hex("rgb"), 256).alias("digest")).agg(F.count("*").alias("n"))


@query(f"with {DIGESTS} select digest as asset_key, 8 as w, 8 as h, count(*) as uses, digest from dg group by digest")
def stored_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as images in files, written twice, and the pixels of these files"""
    path = shared(spark, "assets")
    images = grey_images(spark, sf_dir).select(F.sha2(F.hex("rgb"), 256).alias("asset_key"), F.lit(8).alias("w"), F.lit(8).alias("h"), "rgb")
    written, _ = assets.store(images, path)
    if assets.store(images, path) != (0, written):
        raise RuntimeError("an asset was written again")
    uses = images.groupBy("asset_key").agg(F.count("*").alias("uses"))
    return assets.stored(spark, path).join(uses, "asset_key").select("asset_key", "w", "h", "uses", F.sha2(F.hex("rgb"), 256).alias("digest"))


@query(f"""with {PIXELS} select vec_id as block, 8 as w, 8 as h, sha256(string_agg(repeat(printf('%02X', a), 3), '' order by i)) as digest from px group by 1""")
def joined_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles spliced to blocks again"""
    out = render.join_tiles(cut_images(spark, sf_dir).select(F.col("frame").alias("block"), "col", "row", "rgb"), 4)
    return out.select("block", "w", "h", F.sha2(F.hex("rgb"), 256).alias("digest"))


@query(f"""with {PIXELS} select vec_id, i // 3 as k, trunc(0.299::double * max(a) filter (i % 3 = 0) + 0.587::double * max(a) filter (i % 3 = 1) + 0.114::double * max(a) filter (i % 3 = 2))::int as luma
from px where i < 63 group by 1, 2""")
def pixel_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three numbers of an embedding as one pixel"""
    part = lambda c: F.max(F.when(F.col("i") % 3 == c, F.col("a")))
    px = pixels(spark, sf_dir).where("i < 63").groupBy("vec_id", F.floor(F.col("i") / 3).alias("k"))
    return px.agg(X.luma(part(0), part(1), part(2)).alias("luma"))


@query("""with d as (select o_orderkey, (o_custkey % 1280 + 1)::int as w, (o_orderkey % 720 + 1)::int as h, o_orderpriority || '.png' as base from orders),
g as (select *, (w - 1) // 16 as c, (h - 1) // 16 as r, greatest(640.0 / w, 480.0 / h) as fit from d)
select o_orderkey, (c * 16)::int as x, (r * 16)::int as y, least(16, w - c * 16)::int as w, least(16, h - r * 16)::int as h, w - c * 16 >= 16 and h - r * 16 >= 16 as is_full,
 round(480.0 / h, 6) as scale, round((w / (h / 480.0) - 640.0) / 2, 6) + 0.0::double as off_x, round(fit, 6) as fit, round(w / 2.0 * fit - 320, 6) + 0.0::double as fit_x, round(h / 2.0 * fit - 240, 6) + 0.0::double as fit_y,
 round(10 * fit - (w / 2.0 * fit - 320), 6) + 0.0::double as on_canvas, 10.0::double as on_pixel, replace(base, '.', (o_orderkey % 7)::varchar || '.') as path from g""")
def tile_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a frame of its own size, with its last tile"""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_custkey") % 1280 + 1).cast("int").alias("w"), (F.col("o_orderkey") % 720 + 1).cast("int").alias("h"))
    col, row = (F.floor((F.col(c) - 1) / 16).cast("int") for c in "wh")
    o = o.select("*", X.tile_bounds(col, row, 16, F.col("w"), F.col("h")).alias("tile"), X.canvas_mapping(F.col("w"), F.col("h")).alias("map"), X.centred_mapping(F.col("w"), F.col("h"), F.lit(320.0), F.lit(240.0)).alias("fit"))
    on_canvas = X.to_canvas(F.lit(10.0), F.col("fit.scale"), F.col("fit.off_x"))
    return o.select(
        "o_orderkey", "tile.*", X.is_full_tile(F.col("tile"), 16).alias("is_full"), F.round("map.scale", 6).alias("scale"), F.round("map.off_x", 6).alias("off_x"),
        F.round("fit.scale", 6).alias("fit"), F.round("fit.off_x", 6).alias("fit_x"), F.round("fit.off_y", 6).alias("fit_y"), F.round(on_canvas, 6).alias("on_canvas"),
        F.round(X.to_pixel(on_canvas, F.col("fit.scale"), F.col("fit.off_x")), 6).alias("on_pixel"), X.frame_path(F.concat("o_orderpriority", F.lit(".png")), (F.col("o_orderkey") % 7)).alias("path"),
    )


@query("""with d as (select o_orderkey, o_custkey, o_orderkey % 3 as form, round(o_totalprice * 1000)::bigint as n, o_custkey % 60 as ss, o_orderkey % 60 as mm, o_orderkey % 24 as hh from orders)
select o_orderkey, case when form > 0 then (o_custkey % 2000)::int end as w, case when form > 0 then mm::int end as h,
 case form when 0 then ss when 1 then mm * 60 + ss else hh * 3600 + mm * 60 + ss end::double as seconds,
 regexp_replace((case when n < 1024 then n when n < 1048576 then round(n / 1024, 2) when n < 1073741824 then round(n / 1048576, 2) else round(n / 1073741824, 2) end)::double::varchar, '\\.0$', '')
  || case when n < 1024 then ' B' when n < 1048576 then ' KB' when n < 1073741824 then ' MB' else ' GB' end as size,
 case when ss = 0 then 0 else round(1 - mm / ss, 6) end::double as saved, n::varchar as ms from d""")
def read_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and times read from texts, and numbers written as texts"""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 2000).alias("w"), (F.col("o_orderkey") % 3).alias("form"), F.round(F.col("o_totalprice") * 1000).cast("long").alias("n"), (F.col("o_custkey") % 60).alias("ss"), (F.col("o_orderkey") % 60).alias("mm"), (F.col("o_orderkey") % 24).alias("hh"))
    size = X.parse_size(F.when(F.col("form") > 0, F.concat("w", F.lit("x"), "mm")).otherwise(F.concat("w", F.lit("by"), "mm")))
    time = F.when(F.col("form") == 0, F.col("ss").cast("string")).when(F.col("form") == 1, F.concat_ws(":", "mm", "ss")).otherwise(F.concat_ws(":", "hh", "mm", "ss"))
    return o.select(
        "o_orderkey", size["w"].alias("w"), size["h"].alias("h"), X.parse_time(time).alias("seconds"), X.format_bytes(F.col("n")).alias("size"),
        F.round(X.reduction(F.col("mm"), F.col("ss")), 6).alias("saved"), X.format_time(F.col("n").cast("double")).alias("ms"),
    )


@query("""select sha256(o_orderstatus || chr(31) || o_orderpriority) as content, count(*) as n from orders group by o_orderstatus, o_orderpriority""")
def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5"""
    return table(spark, sf_dir, "orders").groupBy(X.content_hash(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("content")).agg(F.count("*").alias("n"))


@query(f"""with o(k, name, fx, fy) as (values {", ".join(f"({i}, '{n}', {x}, {y})" for i, (n, (x, y)) in enumerate(X.ORIGINS.items()))}),
d as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity as q, l_partkey % 10 as k, l_partkey % 5 as layer, l_tax::float as a, l_discount::float as b, (l_suppkey % 11 / 10)::float as p, l_returnflag = 'N' as forever, trunc((l_quantity * 10 - 100) / 7)::bigint as f from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, q, case when q / 10 > 1 then (q / 10) % 1 else q / 10 end as alpha, round((a + (b - a) * p)::double, 5) as mixed,
 case when forever then (f % 9 + 9) % 9 else greatest(0, least(f, 8)) end as frame, name as origin, fx::double as fx, fy::double as fy, layer::int as layer from d join o using (k)""")
def object_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as objects of a layer and origin"""
    names = F.array(*[F.lit(x) for x in X.ORIGINS])
    l = table(spark, sf_dir, "lineitem").withColumn("origin", F.get(names, (F.col("l_partkey") % 10).cast("int"))).withColumn("layer_name", F.get(F.array(*[F.lit(x) for x in X.LAYERS]), (F.col("l_partkey") % 5).cast("int")))
    place = X.origin_fraction(F.col("origin"))
    return l.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("q"), X.flicker(F.col("l_quantity") / 10).alias("alpha"),
        F.round(X.lerp(F.col("l_tax"), F.col("l_discount"), F.col("l_suppkey") % 11 / 10).cast("double"), 5).alias("mixed"),
        X.animation_frame(F.col("l_quantity") * 10, F.lit(100.0), F.lit(7.0), F.lit(9), F.col("l_returnflag") == "N").cast("long").alias("frame"),
        "origin", place["fx"].alias("fx"), place["fy"].alias("fy"), X.layer_ordinal(F.col("layer_name")).cast("int").alias("layer"),
    )
