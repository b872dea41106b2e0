"""Kernels applied to the order and event tables. Every query reads its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric, predicates
from ..operators import assign, coverage, graph, ordered, ranges, sets, stats
from ..tables import Scratch
from .registry import DAY, HOUR, exact_sum, micros, query, table


def _events(spark: SparkSession, sf_dir: str, hours: int = 1) -> DataFrame:
    s = micros("ts")
    return table(spark, sf_dir, "events").select("user_id", "event_id", s.alias("start"), (s + hours * HOUR).alias("end"), "value")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("day", F.floor(micros("o_orderdate") / DAY).cast("long"))


O_DAY = "epoch_us(o_orderdate) // 86400000000"


@query("""
select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as price, l_quantity >= 25 as is_big,
  case when l_discount > 0.07 then 'high' when l_discount > 0.03 then 'mid' else 'low' end as band
from lineitem where l_returnflag <> 'N' and l_quantity between 5 and 45""")
def flag_filter_project(spark, sf_dir):
    """Conditions and derived columns in one projection; the filter reaches the scan (read_predicates has the conditions of reads)."""
    band = F.when(F.col("l_discount") > 0.07, "high").when(F.col("l_discount") > 0.03, "mid").otherwise("low")
    df = table(spark, sf_dir, "lineitem").where((F.col("l_returnflag") != "N") & F.col("l_quantity").between(5, 45))
    return df.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price"), (F.col("l_quantity") >= 25).alias("is_big"), band.alias("band"))


@query("""
select route, count(*) as n, sum(l_quantity::bigint)::bigint as quantity from (
  select 'returned' as route, l_quantity from lineitem where l_returnflag = 'R'
  union all select 'accepted', l_quantity from lineitem where l_returnflag = 'A'
  union all select 'large', l_quantity from lineitem where l_quantity > 40
  union all select 'discounted', l_quantity from lineitem where l_quantity <= 40 and l_discount >= 0.05) group by route""")
def route_multi_output(spark, sf_dir):
    """F16: one pass, a row goes to several outputs by chains of conditions."""
    r, q, d = F.col("l_returnflag"), F.col("l_quantity"), F.col("l_discount")
    routes = predicates.multi_route([(r == "R", "returned"), (r == "A", "accepted")], [(q > 40, "large"), (d >= 0.05, "discounted")])
    df = table(spark, sf_dir, "lineitem").select(F.explode(routes).alias("route"), F.col("l_quantity").cast("long").alias("q"))
    return df.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("quantity"))


@query(f"""
with o as (select o_custkey, o_orderkey, {O_DAY} as s, {O_DAY} + 30 as e from orders)
select a.o_custkey, a.o_orderkey as first_key, b.o_orderkey as second_key, (least(a.e, b.e) - greatest(a.s, b.s))::bigint as shared
from o a join o b on a.o_custkey = b.o_custkey and a.s <= b.e and a.e >= b.s and a.o_orderkey < b.o_orderkey""")
def range_overlap_join(spark, sf_dir):
    """Pairs of a customer's orders whose 30-day windows overlap, ends included."""
    o = _orders(spark, sf_dir).select("o_custkey", F.col("o_orderkey").alias("first_key"), F.col("day").alias("s1"), (F.col("day") + 30).alias("e1"))
    p = o.select("o_custkey", F.col("first_key").alias("second_key"), F.col("s1").alias("s2"), F.col("e1").alias("e2"))
    met = ranges.range_join(o, p, ["o_custkey"], ("s1", "e1"), ("s2", "e2"), 31, F.col("first_key") < F.col("second_key"))
    return met.select("o_custkey", "first_key", "second_key", (F.least("e1", "e2") - F.greatest("s1", "s2")).alias("shared"))


@query(f"""
with o as (select o_custkey, o_orderkey, {O_DAY} as s from orders)
select a.o_custkey, a.o_orderkey as outer_key, b.o_orderkey as inner_key from o a join o b
on a.o_custkey = b.o_custkey and b.s >= a.s and b.s + 10 <= a.s + 60 and a.o_orderkey <> b.o_orderkey""")
def range_contains_join(spark, sf_dir):
    """60-day windows that hold another order's 10-day window."""
    o = _orders(spark, sf_dir)
    a = o.select("o_custkey", F.col("o_orderkey").alias("outer_key"), F.col("day").alias("s1"), (F.col("day") + 60).alias("e1"))
    b = o.select("o_custkey", F.col("o_orderkey").alias("inner_key"), F.col("day").alias("s2"), (F.col("day") + 10).alias("e2"))
    return ranges.contains_join(a, b, ["o_custkey"], ("s1", "e1"), ("s2", "e2"), 61).where("outer_key <> inner_key").select("o_custkey", "outer_key", "inner_key")


@query("""
select l_orderkey, l_linenumber, l_partkey, (epoch_us(l_shipdate) // 86400000000 - epoch_us(o_orderdate) // 86400000000)::bigint as days
from lineitem join orders on l_orderkey = o_orderkey
where epoch_us(l_shipdate) // 86400000000 between epoch_us(o_orderdate) // 86400000000 and epoch_us(o_orderdate) // 86400000000 + 90""")
def point_in_range_join(spark, sf_dir):
    """Ship dates within 90 days of the order. The equi key is nearly unique, so one bin a key is enough."""
    o = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("l_orderkey"), "day", (F.col("day") + 90).alias("until"))
    ship = F.floor(micros("l_shipdate") / DAY).cast("long")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ship.alias("ship"))
    met = li.join(o, "l_orderkey").where(F.col("ship").between(F.col("day"), F.col("until")))
    return met.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("ship") - F.col("day")).alias("days"))


@query("""
with d as (select event_id, user_id, epoch_us(ts) // 3600000000 as h from events), w as (select distinct user_id, h // 48 as w from d)
select d.user_id, d.event_id, w.w as window_number from d join w on d.user_id = w.user_id and d.h between w.w * 48 and w.w * 48 + 23""")
def windowed_point_join(spark, sf_dir):
    """J4 with wide ranges: events of the first day of each two-day window in which the user has an event."""
    h = F.floor(micros("ts") / HOUR).cast("long")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", h.alias("h"))
    w = e.select("user_id", F.floor(F.col("h") / 48).alias("window_number")).distinct()
    w = w.select("user_id", "window_number", (F.col("window_number") * 48).alias("lo"), (F.col("window_number") * 48 + 23).alias("hi"))
    return ranges.point_join(e, w, ["user_id"], "h", ("lo", "hi"), 48).select("user_id", "event_id", "window_number")


@query("""
with e as (select user_id, epoch_us(ts) as t from events),
f as (select user_id, t, case when t - lag(t) over w > 21600000000 or lag(t) over w is null then 1 else 0 end as new from e window w as (partition by user_id order by t)),
s as (select user_id, t, sum(new) over (partition by user_id order by t rows unbounded preceding) as session from f)
select user_id, session::bigint as session, count(*) as n_events, min(t) as first_us, max(t) as last_us from s group by user_id, session""")
def gap_sessions(spark, sf_dir):
    """Events of a user at most six hours apart."""
    s = ranges.sessions(_events(spark, sf_dir), ["user_id"], "start", 6 * HOUR)
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n_events"), F.min("start").alias("first_us"), F.max("start").alias("last_us"))


@query("""
with e as (select user_id, event_id, epoch_us(ts) as t from events)
select a.user_id, a.event_id as a_id, b.event_id as b_id, b.t - a.t as gap_us from e a join e b
on a.user_id = b.user_id and b.t - a.t between 0 and 21600000000 and (b.t > a.t or b.event_id > a.event_id)""")
def band_self_join_sessions(spark, sf_dir):
    """Pairs of a user's events at most six hours apart."""
    e = _events(spark, sf_dir).select("user_id", "event_id", "start")
    met = ranges.band_self_join(e, ["user_id"], "start", 6 * HOUR, "event_id")
    return met.select("user_id", F.col("a.event_id").alias("a_id"), F.col("b.event_id").alias("b_id"), (F.col("b.start") - F.col("a.start")).alias("gap_us"))


@query("""
with j as (select l_returnflag, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) // 86400000000 as d, l_quantity from lineitem join orders on l_orderkey = o_orderkey)
select l_returnflag, case when d > 365 then 'alt' when d >= 0 then 'ref' else 'neutral' end as label, count(*) as n, count_if(l_quantity >= 25)::bigint as n_big,
  min(d)::bigint as min_days, max(d)::bigint as max_days from j group by all""")
def pair_state_label(spark, sf_dir):
    """Three-way label of joined rows by the sign and size of a distance, then conditional counts."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), micros("o_orderdate").alias("o"))
    j = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity", micros("l_shipdate").alias("s")).join(o, "l_orderkey")
    d = F.floor((F.col("s") - F.col("o")) / DAY).cast("long")
    label = F.when(F.col("d") > 365, "alt").when(F.col("d") >= 0, "ref").otherwise("neutral")
    return j.withColumn("d", d).groupBy("l_returnflag", label.alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") >= 25).alias("n_big"), F.min("d").alias("min_days"), F.max("d").alias("max_days"))


@query(f"""
with o as (select o_custkey, o_orderkey, {O_DAY} as s from orders),
n as (select a.o_orderkey from o a join o b on a.o_custkey = b.o_custkey and a.o_orderkey <> b.o_orderkey and abs(a.s - b.s) <= 30 group by a.o_orderkey having count(*) = 1)
select o_orderkey, o_custkey, s::bigint as day from o where o_orderkey not in (select o_orderkey from n)""")
def anti_exactly_one(spark, sf_dir):
    """Orders but those that meet exactly one other of their customer within 30 days."""
    o = _orders(spark, sf_dir).select("o_orderkey", "o_custkey", "day", (F.col("day") + 30).alias("until"))
    other = o.select("o_custkey", F.col("day").alias("s2"), (F.col("day") + 30).alias("e2"))
    # Every order meets itself, so one other makes two.
    return ranges.overlap_semi(o, other, ["o_custkey"], ("day", "until"), ("s2", "e2"), 31, ["o_orderkey"], anti=True, exactly=2).drop("until")


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def semi_join(spark, sf_dir):
    """Customers with an urgent order."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT' and o_custkey is not null)")
def anti_join(spark, sf_dir):
    """Customers without an urgent order."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""
select n_name, count(*) as n_orders, sum(o_totalprice::decimal(18,2))::double as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name""")
def equi_join(spark, sf_dir):
    """Equi joins; the nation table is small by its file size, so Spark broadcasts it unasked."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return o.join(c, "c_custkey").join(table(spark, sf_dir, "nation"), "n_nationkey").groupBy("n_name").agg(F.count(F.lit(1)).alias("n_orders"), exact_sum("o_totalprice").alias("total"))


@query("""
select c_custkey, coalesce(n, 0) as n_orders, coalesce(s, 'none') as last_status from customer
left join (select o_custkey, count(*) as n, max_by(o_orderstatus, (epoch_us(o_orderdate), o_orderkey)) as s from orders group by o_custkey) on c_custkey = o_custkey""")
def left_join_coalesce(spark, sf_dir):
    """Predictions joined to records; records without one get a default."""
    latest = F.max_by("o_orderstatus", F.struct(micros("o_orderdate"), F.col("o_orderkey")))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), latest.alias("s"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("s", F.lit("none")).alias("last_status"))


@query("""
select l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_suppkey from lineitem
qualify row_number() over (partition by l_orderkey, l_linenumber order by l_extendedprice desc, l_partkey, l_suppkey) = 1""")
def dedup_keep_best(spark, sf_dir):
    """Of equal keys the row with the highest price."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    return sets.keep_best(li, ["l_orderkey", "l_linenumber"], [F.desc("l_extendedprice"), "l_partkey", "l_suppkey"])


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def duplicate_keys(spark, sf_dir):
    """U4: keys that occur twice."""
    return sets.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
select l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_suppkey from lineitem
qualify row_number() over (partition by l_orderkey, l_linenumber order by l_extendedprice, l_partkey, l_suppkey, l_quantity) <= 2""")
def dedup_at_most_n(spark, sf_dir):
    """At most two rows of a key."""
    li = table(spark, sf_dir, "lineitem")
    return sets.at_most(li, ["l_orderkey", "l_linenumber"], 2, ["l_extendedprice", "l_partkey", "l_suppkey", "l_quantity"]).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")


@query("select r_regionkey as key, r_name as name, 0 as stream from region union all select n_nationkey, n_name, 1 from nation")
def union_sorted(spark, sf_dir):
    """Merge of sorted inputs; ties go to the first stream."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return sets.merged([r, n], ["key"])


@query("""
select c_custkey as key, c_name as name from customer union all
select s_suppkey, s_name from supplier where s_suppkey not in (select c_custkey from customer)""")
def union_first_source(spark, sf_dir):
    """Union where the first source wins a key."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return sets.first_source([c, s], ["key"], ["name"])


@query("""
with p as (select a.o_orderkey as x, b.o_orderkey as y, a.o_totalprice as p, b.o_totalprice as q from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey
  and abs(epoch_us(a.o_orderdate) // 86400000000 - epoch_us(b.o_orderdate) // 86400000000) <= 7),
lost as (select case when p < q then x when q < p then y end as k from p)
select o_orderkey, o_totalprice from orders where o_orderkey not in (select k from lost where k is not null)""")
def dedup_by_match(spark, sf_dir):
    """Of a customer's orders within a week the lower total goes; equal ones both stay."""
    o = _orders(spark, sf_dir).select("o_custkey", "o_orderkey", "day", "o_totalprice")
    pairs = ranges.band_self_join(o, ["o_custkey"], "day", 7, "o_orderkey").select(F.col("a.o_orderkey").alias("a"), F.col("b.o_orderkey").alias("b"))
    return sets.drop_beaten(o, pairs, "o_orderkey", F.lit(True), "o_totalprice").select("o_orderkey", "o_totalprice")


@query("""
with q as (select l_returnflag, l_linestatus, l_quantity as q, l_discount >= 0.05 as k, l_tax >= 0.04 as f from lineitem)
select l_returnflag, l_linestatus, count_if(k)::bigint as d_n, count_if(k and f)::bigint as d_fwd, count_if(k and not f)::bigint as d_rev, count_if(k and f and q >= 30)::bigint as d_fwd_hq, count_if(k and not f and q >= 30)::bigint as d_rev_hq,
  min(q) filter (k) as d_min_q, max(q) filter (k) as d_max_q, round(avg(q) filter (k), 4) as d_avg_q, round(stddev_pop(q) filter (k), 4) as d_sd_q from q group by all""")
def support_aggregate(spark, sf_dir):
    """All conditional aggregates in one pass."""
    q = F.col("l_quantity")
    cols = stats.support("d", F.col("l_discount") >= 0.05, F.col("l_tax") >= 0.04, q, 30)
    out = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(*cols)
    return out.withColumns({"d_avg_q": F.round("d_avg_q", 4), "d_sd_q": F.round("d_sd_q", 4)})


@query("""
with m as (select o_orderpriority as p, avg(o_totalprice) as m, stddev_pop(o_totalprice) as s from orders group by 1),
k as (select o_orderpriority as p, o_totalprice as x from orders join m on o_orderpriority = p where abs(o_totalprice - m) <= 1.5 * s),
n as (select p, count(*) as n, trunc(avg(x))::bigint as mean, trunc(stddev_pop(x))::bigint as sd from k group by p)
select n.p as o_orderpriority, n, mean, sd, round(sqrt(avg((x - mean) * (x - mean)) filter (x <= mean)), 3) as sd_below, round(sqrt(avg((x - mean) * (x - mean)) filter (x >= mean)), 3) as sd_above from k join n using (p) group by all""")
def outlier_trim_stats(spark, sf_dir):
    """A1-A3: moments again without outliers, one-sided deviations."""
    out = stats.trimmed_moments(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", 1.5)
    return out.select("o_orderpriority", "n", "mean", "sd", F.round("sd_below", 3).alias("sd_below"), F.round("sd_above", 3).alias("sd_above"))


@query("""
with r as (select l_returnflag, l_extendedprice as x, row_number() over (partition by l_returnflag order by l_extendedprice) - 1 as k, count(*) over (partition by l_returnflag) as n from lineitem)
select l_returnflag, max(x) filter (k = n // 100) as p1, max(x) filter (k = n // 2) as p50, max(x) filter (k = least(n - n // 100, n - 1)) as p99 from r group by l_returnflag""")
def order_statistics(spark, sf_dir):
    """A4: order statistics without interpolation."""
    return stats.order_statistics(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")


@query("""
with h as (select l_linestatus, l_quantity as v, count(*) as c from lineitem group by all),
r as (select *, sum(c) over (partition by l_linestatus order by v) as s, sum(c) over (partition by l_linestatus) as t from h)
select l_linestatus, min(v) filter (s > 0.01 * t) as low, min(v) filter (s > 0.5 * t) as median, min(v) filter (s > 0.99 * t) as high from r group by 1""")
def histogram_tails(spark, sf_dir):
    """Tails and median from a histogram; windows run over distinct values only."""
    return stats.histogram_tails(stats.histogram(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_quantity"), ["l_linestatus"])


@query("""
with h as (select p_brand, p_size as value, count(*) as c from part group by all)
select p_brand, value, sum(c) over (partition by p_brand order by value desc)::bigint as at_or_above, sum(c) over (partition by p_brand order by value)::bigint as at_or_below from h""")
def tail_counts(spark, sf_dir):
    """How many rows lie at or above, and at or below, each value."""
    return stats.tail_counts(table(spark, sf_dir, "part"), ["p_brand"], "p_size")


@query("""
with m as (select l_returnflag, median(l_discount + 0.0) as m from lineitem group by 1), d as (select l_returnflag, m, median(abs(l_discount - m)) as d from lineitem join m using (l_returnflag) group by all)
select l_returnflag, round(m, 6) as median, round(d, 6) as mad, round(least(0.75, greatest(0.0, m + 4 * 1.4826 * d)), 6) as threshold from d""")
def mad_threshold(spark, sf_dir):
    """Median plus four scaled absolute deviations, capped."""
    out = stats.mad_threshold(table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_discount") + 0.0).alias("d")), ["l_returnflag"], "d")
    return out.select("l_returnflag", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), F.round("threshold", 6).alias("threshold"))


@query("""
with j as (select n_name, l_quantity as q from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
h as (select n_name, q, count(*) as c from j group by n_name, q), m as (select *, row_number() over (partition by n_name order by c desc, q) as r from h),
i as (select n_name, quantile_cont(q, 0.75) - quantile_cont(q, 0.25) as iqr from j group by n_name)
select m.n_name, m.q as "mode", m.c as mode_count, i.iqr from m join i on m.n_name = i.n_name where m.r = 1""")
def mode_iqr(spark, sf_dir):
    """Mode with ties to the smaller value, and interpolated quartile distance."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    j = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity").join(s, "l_suppkey").join(table(spark, sf_dir, "nation"), "n_nationkey").select("n_name", "l_quantity")
    return stats.mode(j, ["n_name"], "l_quantity").join(j.groupBy("n_name").agg(stats.iqr("l_quantity").alias("iqr")), "n_name")


MERGED = """
with e as (select user_id, epoch_us(ts) as s, epoch_us(ts) + 7200000000 as e from events),
f as (select *, case when s > max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) then 1 else 0 end as new from e),
g as (select *, sum(new) over (partition by user_id order by s, e rows unbounded preceding) as island from f),
i as (select user_id, min(s) as start, max(e) as "end", count(*) as n from g group by user_id, island)"""


@query(MERGED + ' select user_id, start, "end", n from i')
def interval_merge(spark, sf_dir):
    """Islands of two-hour intervals per user."""
    return ranges.merge_intervals(_events(spark, sf_dir, 2), ["user_id"], ("start", "end"))


@query(MERGED + ' select user_id, sum("end" - start)::bigint as covered from i group by 1')
def covered_length(spark, sf_dir):
    """Time under at least one interval."""
    return ranges.covered_length(_events(spark, sf_dir, 2), ["user_id"], ("start", "end"))


@query("""
with e as (select user_id, epoch_us(ts) as s, epoch_us(ts) + 3600000000 as e from events),
w as (select user_id, s, e, unnest(range(s // 86400000000, (e - 1) // 86400000000 + 1)) as w from e),
d as (select user_id, w, greatest(s, w * 86400000000) as pos, 1 as d from w union all select user_id, w, least(e, (w + 1) * 86400000000), -1 from w),
c as (select user_id, w, pos, sum(d) as d from d group by all),
r as (select user_id, w, sum(d) over (partition by user_id, w order by pos) as depth from c)
select user_id, w as "window", max(depth)::bigint as max_depth from r group by all""")
def window_max_depth(spark, sf_dir):
    """Most one-hour intervals at a time, per user and day."""
    return coverage.window_max_depth(_events(spark, sf_dir), ["user_id"], "start", "end", DAY)


@query("""
select o_custkey, sum((month(o_orderdate) = 1)::int)::bigint as "1", sum((month(o_orderdate) = 2)::int)::bigint as "2", sum((month(o_orderdate) = 3)::int)::bigint as "3", sum((month(o_orderdate) = 4)::int)::bigint as "4", sum((month(o_orderdate) = 5)::int)::bigint as "5", sum((month(o_orderdate) = 6)::int)::bigint as "6", sum((month(o_orderdate) = 7)::int)::bigint as "7", sum((month(o_orderdate) = 8)::int)::bigint as "8", sum((month(o_orderdate) = 9)::int)::bigint as "9", sum((month(o_orderdate) = 10)::int)::bigint as "10", sum((month(o_orderdate) = 11)::int)::bigint as "11", sum((month(o_orderdate) = 12)::int)::bigint as "12" from orders group by 1""")
def cohort_pivot(spark, sf_dir):
    """K6: one column a value, by pivot over all values that there can be, the months."""
    o = table(spark, sf_dir, "orders").withColumn("m", F.month("o_orderdate"))
    return sets.pivoted(o, ["o_custkey"], "m", list(range(1, 13)), F.count(F.lit(1))).na.fill(0)


@query("""
with n as (select lang, count_if(quality = 1 and toxic = 0)::bigint as tp, count_if(quality = 0 and toxic = 0)::bigint as fp, count_if(quality = 1 and toxic = 1)::bigint as fn, count_if(quality = 0 and toxic = 1)::bigint as tn from labels join documents using (doc_id) group by 1)
select *, tp / nullif(tp + fn, 0) as recall, tp / nullif(tp + fp, 0) as precision, 2 * tp / nullif(2 * tp + fp + fn, 0) as f1 from n""")
def confusion_counts(spark, sf_dir):
    """A confusion table and its rates; no rate without a denominator."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    j = table(spark, sf_dir, "labels").join(d, "doc_id").select("lang", F.col("quality").alias("t"), (F.col("toxic") == 0).alias("c"))
    return sets.confusion(j, ["lang"], "t", "c")


@query("""
select l_suppkey, count(distinct l_partkey) as n_parts, round(count(distinct l_partkey) / (2000.0 * (1 - pow(1 - 1 / 2000.0, count(l_partkey)))), 6) as occupancy from lineitem group by 1""")
def occupancy_ratio(spark, sf_dir):
    """Distinct parts over the number expected from as many draws."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("n_parts"), F.round(stats.occupancy("l_partkey", F.lit(2000)), 6).alias("occupancy"))


@query("""
with w as (select user_id, epoch_us(ts) as t, sum((value * 1000)::bigint) over (partition by user_id order by epoch_us(ts) range between 86400000000 preceding and current row)::bigint as s from events)
select user_id, t as window_end, s as window_sum from w qualify row_number() over (partition by user_id order by s desc, t) = 1""")
def max_sum_window(spark, sf_dir):
    """The day-long window with the largest sum."""
    e = _events(spark, sf_dir).withColumn("v", F.round(F.col("value") * 1000).cast("long"))
    return ordered.max_sum_window(e, ["user_id"], "start", "v", DAY)


@query("""
with h as (select l_suppkey, l_partkey, count(*) as c from lineitem group by all)
select l_suppkey, l_partkey as mode, c as mode_count from h qualify row_number() over (partition by l_suppkey order by c desc, l_partkey desc) = 1""")
def mode_and_argmax_tie(spark, sf_dir):
    """The most supported value, ties to the largest."""
    return stats.mode(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_partkey", largest=True)


@query("""
with m as (select o_custkey, max(o_totalprice) as t from orders group by 1)
select o_custkey, t as top, string_agg(o_orderpriority, ',' order by o_orderpriority) as names from (select distinct o_custkey, t, o_orderpriority from orders join m using (o_custkey) where o_totalprice = t) group by all""")
def argmax_all_ties(spark, sf_dir):
    """The largest value of a key and all names that reach it."""
    return sets.top_tied(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", "o_orderpriority")


@query("""
with m as (select o_custkey, o_orderpriority, max(o_totalprice) as m from orders group by all) select o_custkey, avg(m) as mean_max from m group by 1""")
def max_then_mean(spark, sf_dir):
    """Mean over items of each item's largest value."""
    return sets.max_then_mean(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", "o_totalprice")


@query("select l_partkey, l_suppkey, l_orderkey, l_extendedprice from lineitem qualify rank() over (partition by l_partkey order by l_extendedprice desc) = 1")
def read_ownership(spark, sf_dir):
    """All rows that reach an item's highest score own it."""
    return assign.shared_owners(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_extendedprice").select("l_partkey", "l_suppkey", "l_orderkey", "l_extendedprice")


@query()
def read_ownership_exclusive(spark, sf_dir):
    """One supplier a part: unique best, else a draw by hash between the two with the most unique parts."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("part"), F.col("l_suppkey").alias("owner"), F.floor("l_quantity").alias("score"), (1 - F.col("l_discount") * 10).alias("q"))
    per = li.groupBy("part", "owner").agg(F.max("score").alias("score"), F.max("q").alias("q"))
    return assign.exclusive_owner(per, "part", "owner", "score", "q", seed=1)


@query("""
with o as (select l_suppkey, l_partkey, l_linenumber, max((l_discount > 0.05)::int) as f from lineitem group by all)
select l_suppkey, l_linenumber, count(*) as n, sum(f)::bigint as n_flagged from o group by all""")
def other_support(spark, sf_dir):
    """Items counted once for each target and point, their flags joined by or."""
    li = table(spark, sf_dir, "lineitem").withColumn("f", F.col("l_discount") > 0.05)
    return assign.other_support(li, "l_suppkey", "l_partkey", "l_linenumber", "f")


@query()
def capacity_accept(spark, sf_dir):
    """Two-hour events of a user by falling value while fewer than two are open at any time."""
    e = _events(spark, sf_dir, 2)
    return ordered.accept_by_capacity(e, ["user_id"], "start", "end", "value", ["event_id"], 2)


@query()
def greedy_matching(spark, sf_dir):
    """Clicks and purchases of a user within two hours matched one to one, the nearest first."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", micros("ts").alias("t"))
    a = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("a"), F.col("t").alias("ta"))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("b"), (F.col("t") - 2 * HOUR).alias("lo"), (F.col("t") + 2 * HOUR).alias("hi"), F.col("t").alias("tb"))
    pairs = ranges.point_join(a, b, ["user_id"], "ta", ("lo", "hi"), 4 * HOUR).select("user_id", "a", "b", F.abs(F.col("ta") - F.col("tb")).alias("cost"))
    return ordered.greedy_pairs(pairs, ["user_id"], "a", "b", "cost")


@query()
def anchored_chains(spark, sf_dir):
    """Chains of events at most six hours from their first."""
    return ordered.anchored_chains(_events(spark, sf_dir).select("user_id", "event_id", "start"), ["user_id"], "start", 6 * HOUR, ["event_id"])


@query("""
with e as (select user_id, epoch_us(ts) as s, epoch_us(ts) + 43200000000 as e from events),
d as (select user_id, s as pos, 1 as d, 0 as o from e union all select user_id, e, -1, 1 from e),
r as (select user_id, pos, sum(d) over (partition by user_id order by pos, o rows unbounded preceding) as depth from d)
select user_id, pos, depth::bigint as depth from r qualify row_number() over (partition by user_id order by depth desc, pos) = 1""")
def deepest_point(spark, sf_dir):
    """The point that most twelve-hour intervals share."""
    return ordered.deepest_point(_events(spark, sf_dir, 12), ["user_id"], "start", "end")


@query()
def insert_while_querying(spark, sf_dir):
    """In order of value, an interval is let in if it meets none let in before."""
    e = _events(spark, sf_dir, 3).withColumn("rank", -F.col("value"))
    return ordered.insert_while_querying(e, ["user_id"], "start", "end", ["rank", "event_id"])


@query()
def clique_cover(spark, sf_dir):
    """Events of a user within six hours and of like value, covered by cliques."""
    return graph.clique_cover(_events(spark, sf_dir).select("user_id", "event_id", "start", "value"), ["user_id"], "start", 6 * HOUR, _like_value, ["event_id"])


def _like_value(a: dict, b: dict) -> bool:
    return abs(a["value"] - b["value"]) <= 50


@query()
def agglomerative(spark, sf_dir):
    """G1: two-anchor intervals (the event and what follows a day later) joined while both spans stay within a day."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", micros("ts").alias("ls"))
    e = e.select("user_id", "event_id", "ls", (F.col("ls") + HOUR).alias("le"), (F.col("ls") + DAY).alias("rs"), (F.col("ls") + DAY + 2 * HOUR).alias("re"))
    return graph.agglomerate(e, ["user_id"], ("ls", "le"), ("rs", "re"), 8 * HOUR, 100, ["event_id"])


@query(f"""
with o as (select o_custkey, o_orderkey, {O_DAY} as d from orders),
f as (select *, case when d - lag(d) over w > 30 or lag(d) over w is null then 1 else 0 end as new from o window w as (partition by o_custkey order by d, o_orderkey)),
s as (select *, sum(new) over (partition by o_custkey order by d, o_orderkey rows unbounded preceding) as g from f)
select o_orderkey as node, min(o_orderkey) over (partition by o_custkey, g) as component from s qualify count(*) over (partition by o_custkey, g) > 1""")
def connected_components(spark, sf_dir):
    """Orders linked by customer and at most 30 days, by star steps over an edge table."""
    o = _orders(spark, sf_dir).select("o_custkey", "o_orderkey", "day")
    e = ranges.band_self_join(o, ["o_custkey"], "day", 30, "o_orderkey").select(F.col("a.o_orderkey").alias("u"), F.col("b.o_orderkey").alias("v"))
    return graph.connected_components(e, Scratch(spark, "components"))


@query()
def ks_two_sample(spark, sf_dir):
    """P-value of open against filled lines' prices, per return flag (sampled by supplier to a bounded group)."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", (F.col("l_linestatus") == "O").alias("open"))
    return stats.ks_by_group(li, "l_suppkey", "l_extendedprice", "open")


@query("""
with h as (select l_returnflag, l_quantity as x, count_if(l_linestatus = 'O') as a, count_if(l_linestatus <> 'O') as b from lineitem group by all),
d as (select l_returnflag, sum(a) over w as a, sum(b) over w as b, sum(a) over (partition by l_returnflag) as n1, sum(b) over (partition by l_returnflag) as n2 from h window w as (partition by l_returnflag order by x))
select l_returnflag, n1::bigint as n1, n2::bigint as n2, round(max(abs(a / n1 - b / n2)), 9) as d from d group by all""")
def ks_statistic(spark, sf_dir):
    """The test's distance alone, by windows over distinct values."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_linestatus") == "O").alias("open"))
    return stats.ks_statistic(li, ["l_returnflag"], "l_quantity", "open").withColumn("d", F.round("d", 9))


@query("""
select l_suppkey, count(l_quantity) as n, case when count(*) >= 4 then trunc(2.576 * sqrt(var_samp(l_quantity) / count(*)))::bigint end as half_width,
  case when count(*) >= 4 then abs(trunc(avg(l_quantity))::bigint - 25)::bigint end as distance from lineitem group by 1""")
def size_interval(spark, sf_dir):
    """Half-width of a confidence interval and distance from a population mean."""
    return stats.size_interval(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", 25.0)


@query("""
with a as (select l_suppkey as k, avg(l_quantity) as m, stddev_pop(l_quantity) as s, count(*)::double as n, min(l_quantity) as lo, max(l_quantity) as hi from lineitem group by 1),
g as (select avg(l_quantity) as m, stddev_pop(l_quantity) as s, count(*)::double as n from lineitem)
select k as l_suppkey, round((a.m - g.m) / (case when sqrt(a.s * a.s / a.n + g.s * g.s / g.n) = 0 then 1 else sqrt(a.s * a.s / a.n + g.s * g.s / g.n) end), 6) as z,
  round(lo / greatest(1.0, hi), 9) as span_ratio, round(ln(1 + a.n), 6) as log_n from a, g""")
def feature_projection(spark, sf_dir):
    """X39-X41 and the feature families: ratios, z scores and logarithms as one wide projection."""
    li = table(spark, sf_dir, "lineitem")
    agg = [F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("s"), F.count(F.lit(1)).cast("double").alias("n")]
    a = li.groupBy("l_suppkey").agg(*agg, F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    g = li.agg(*[c.alias(f"g_{k}") for c, k in zip(agg, "msn")])
    # One row is joined: a proven bound.
    j = a.join(F.broadcast(g))
    z = numeric.welch_z(*[F.col(c) for c in ("m", "s", "n", "g_m", "g_s", "g_n")])
    return j.select("l_suppkey", F.round(z, 6).alias("z"), F.round(numeric.ratio(F.col("lo"), F.col("hi")), 9).alias("span_ratio"), F.round(F.log1p("n"), 6).alias("log_n"))


@query("""
with v as (select p_partkey, p_size::double - 25 as x, 5.0 as lo, 20.0 as hi from part),
y as (select p_partkey, x, case when abs(x) <= lo then abs(x) / greatest(1.0, lo) * 0.25 when abs(x) > hi then abs(x) / greatest(1.0, hi) * 0.25 + 0.75 else 0.25 + (abs(x) - lo) / (hi - lo) * 0.75 end as y from v)
select p_partkey, round(round_even((case when x < 0 then -y else y end) / 0.025, 0) * 0.025, 6) + 0.0 as scaled from y""")
def piecewise_normalise(spark, sf_dir):
    """Piecewise normalisation, quantised with halves to even."""
    scaled = numeric.piecewise(F.col("p_size").cast("double") - 25, F.lit(5.0), F.lit(20.0))
    return table(spark, sf_dir, "part").select("p_partkey", (F.round(scaled, 6) + 0.0).alias("scaled"))


@query("""
select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 3""")
def cluster_top_k(spark, sf_dir):
    """Three best of a key; the rank limit is applied before the shuffle too."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ordered.ranked(o, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3, "rank").withColumn("rank", F.col("rank").cast("long"))


@query("""
select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by epoch_us(o_orderdate), o_orderkey) - 1 as index from orders""")
def row_index(spark, sf_dir):
    """Index of a row within its key."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", micros("o_orderdate").alias("t"))
    return ordered.row_index(o, ["o_custkey"], ["t", "o_orderkey"]).drop("t")


@query("""
with n as (select o_custkey, count(*) as n from orders group by 1) select o_custkey, n, n > 12 as too_deep, case when n > 12 then null else (select sum(o_totalprice::decimal(18,2))::double from orders o where o.o_custkey = n.o_custkey) end as total from n""")
def too_deep_guard(spark, sf_dir):
    """A guard that flags keys over a cap, instead of cutting them."""
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), exact_sum("o_totalprice").alias("total"))
    return g.select("o_custkey", "n", (F.col("n") > 12).alias("too_deep"), F.when(F.col("n") <= 12, F.col("total")).alias("total"))


@query("""
select case when p_size < 5 then '1-4' when p_size < 15 then '5-14' when p_size < 50 then '15-49' when p_size < 200 then '50-199' when p_size < 1000 then '200-999' when p_size < 5000 then '1000-4999' else '>=5000' end as size_bin, p_brand, count(*) as n from part where p_size >= 1 group by all""")
def size_bins(spark, sf_dir):
    """Counts by size bin."""
    return table(spark, sf_dir, "part").where("p_size >= 1").groupBy(sets.by_size(F.col("p_size")).alias("size_bin"), "p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("""
with w as (select l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_partkey, case when l_quantity >= 25 then l_quantity end as q, l_extendedprice from lineitem)
select l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, last_value(q ignore nulls) over (partition by l_suppkey order by epoch_us(l_shipdate), l_orderkey, l_linenumber, l_partkey, l_extendedprice rows unbounded preceding) as q from w""")
def inherit_previous(spark, sf_dir):
    """A missing value is inherited from the row before."""
    w = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.struct(micros("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_extendedprice")).alias("o"), F.when(F.col("l_quantity") >= 25, F.col("l_quantity")).alias("q"))
    return stats.inherited(w, ["l_suppkey"], "o", "q").drop("o")


@query("""
with h as (select l_returnflag, least(greatest(l_linenumber - 4, -3), 3) as delta, count(*) as reads from lineitem group by all)
select l_returnflag, delta, reads, reads / sum(reads) over (partition by l_returnflag) as rate from h""")
def rate_profile(spark, sf_dir):
    """Counts by clipped difference over their total."""
    h = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.least(F.greatest(F.col("l_linenumber") - 4, F.lit(-3)), F.lit(3)).alias("delta")).agg(F.count(F.lit(1)).alias("reads"))
    return h.withColumn("rate", F.col("reads") / F.sum("reads").over(Window.partitionBy("l_returnflag")))


@query("""
select lang, length(text) as n, length(text) - length(replace(text, 'e', '')) as n_e, contains(text, 'password') as has_secret from documents""")
def text_counts(spark, sf_dir):
    """Letter counts by length differences, substring tests."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("lang", F.length(t).cast("long").alias("n"), (F.length(t) - F.length(F.replace(t, F.lit("e"), F.lit("")))).cast("long").alias("n_e"), t.contains("password").alias("has_secret"))
