"""Registry of the media queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from muxlake.functions import bits, clock, codes
from muxlake.functions.clock import PCR_MOD
from muxlake.operators import captures, convert, elementary, frames, packets, places, reports, tables, transport, trickplay
from muxlake.plans import synthetic as S
from muxlake.sources import files, records
from muxlake.plans.synthetic import CAPTURE, FRAMES, PACKETS, TABLES

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# --- packets -------------------------------------------------------------------------------------


@query(PACKETS + "SELECT pid, count(*) AS packets, count(*) * 188 AS bytes, min(pos) AS first_pos, max(pos) AS last_pos FROM packets GROUP BY pid")
def pid_histogram(spark, d):
    return packets.pid_histogram(S.packets(spark, d)).drop("source")


@query(PACKETS + "SELECT n, pid, pos, kind FROM packets WHERE n < 5000 AND pid IN (260, 261, 300)")
def pid_filter(spark, d):
    return packets.filter_pids(S.packets(spark, d), [260, 261, 300], max_packets=5000).select("n", "pid", "pos", "kind")


@query(PACKETS + "SELECT n, pid, pos, kind FROM packets WHERE pid IN (260, 261, 300)")
def pid_filter_whole(spark, d):
    return packets.filter_pids(S.packets(spark, d), [260, 261, 300]).select("n", "pid", "pos", "kind")


@query(PACKETS + "SELECT n, pid, pos, kind FROM packets WHERE pid NOT IN (260, 261, 300)")
def pid_filter_invert(spark, d):
    return packets.filter_pids(S.packets(spark, d), [260, 261, 300], invert=True).select("n", "pid", "pos", "kind")


@query(PACKETS + "SELECT n, pos, kind, cc FROM packets WHERE pid = 264 ORDER BY pos LIMIT 20")
def single_pid_dump(spark, d):
    return packets.first_of_pid(S.packets(spark, d), 264, 20).select("n", "pos", "kind", "cc")


@query(PACKETS + "SELECT n, pid FROM packets WHERE n % 10 < 7")
def drop_keep_k(spark, d):
    return packets.drop_periodically(S.packets(spark, d), 7, 3).select("n", "pid")


@query(PACKETS + "SELECT n, CASE WHEN pid = 260 THEN 8191 ELSE pid END AS pid FROM packets WHERE pid <> 260 OR pcr IS NOT NULL")
def hide_pid_keep_pcr(spark, d):
    return packets.hide_pid(S.packets(spark, d), 260).select("n", F.col("pid").cast("long").alias("pid"))


CC = (
    PACKETS
    + """, a AS (
  SELECT pid, pos, cc, has_payload, disc, cents % 4 AS content, lag(cc) OVER w AS last, lag(cents % 4) OVER w AS last_content FROM packets WINDOW w AS (PARTITION BY pid ORDER BY pos)),
b AS (
  SELECT *, last IS NOT NULL AND NOT disc AND cc = last AND has_payload AS same, last IS NOT NULL AND NOT disc AND cc <> last AS moved FROM a),
c AS (SELECT *, sum(CASE WHEN moved THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY pos) AS chain FROM b),
g AS (SELECT *, sum(CASE WHEN same THEN 1 ELSE 0 END) OVER (PARTITION BY pid, chain ORDER BY pos) AS nth FROM c)
SELECT pid, count(*) AS packets, count(*) FILTER (WHERE disc) AS flagged, count(*) FILTER (WHERE same AND nth > 1) AS dup_errors,
  count(*) FILTER (WHERE same AND content IS DISTINCT FROM last_content) AS content_errors, count(*) FILTER (WHERE same AND content IS NOT DISTINCT FROM last_content) AS good_dups,
  count(*) FILTER (WHERE moved AND CASE WHEN has_payload THEN (last + 1) % 16 <> cc ELSE true END) AS cc_errors, min_by(cc, pos) AS first_cc
FROM g GROUP BY pid"""
)


@query(CC)
def cc_check(spark, d):
    return packets.continuity(S.packets(spark, d), F.col("cents") % 4).drop("source")


@query(
    PACKETS
    + """, x AS (SELECT pos, cc, coalesce(sum(CASE WHEN cc = 15 THEN 1 ELSE 0 END) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM packets WHERE pid = 264)
SELECT CAST(line AS BIGINT) AS line, string_agg(CAST(cc AS VARCHAR), ' ' ORDER BY pos) AS text FROM x GROUP BY line"""
)
def cc_dump_lines(spark, d):
    return packets.counter_lines(S.packets(spark, d), 264).select("line", "text")


INTERPOLATED = (
    PACKETS
    + f""", i AS (
  SELECT *, last_value(CASE WHEN pcr IS NOT NULL THEN n END IGNORE NULLS) OVER b AS pn, last_value(pcr IGNORE NULLS) OVER b AS pp,
    first_value(CASE WHEN pcr IS NOT NULL THEN n END IGNORE NULLS) OVER a AS nn, first_value(pcr IGNORE NULLS) OVER a AS np
  FROM packets WINDOW b AS (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
j AS (SELECT *, (np - pp + {PCR_MOD}) % {PCR_MOD} // (nn - pn) AS step FROM i WHERE pn IS NOT NULL),
k AS (SELECT *, last_value(CASE WHEN pcr IS NOT NULL THEN step END IGNORE NULLS) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_step FROM j),
timed AS (SELECT n, pos, pid, pts, dts, pcr, (pp + coalesce(step, last_step, 0) * (n - pn)) % {PCR_MOD} AS acc_pcr FROM k)
"""
)


@query(INTERPOLATED + "SELECT n, pid, acc_pcr FROM timed")
def pcr_interpolate(spark, d):
    return packets.interpolate_pcr(S.packets(spark, d)).select("n", "pid", "acc_pcr")


@query(
    PACKETS
    + f""", r AS (
  SELECT pos, pcr, lag(pos) OVER w AS pos1, lag(pcr) OVER w AS pcr1, lag(pos, 2) OVER w AS pos2, lag(pcr, 2) OVER w AS pcr2 FROM packets WHERE pcr IS NOT NULL WINDOW w AS (ORDER BY n)),
s AS (
  SELECT *, (pcr - pcr1 + {PCR_MOD}) % {PCR_MOD} AS gap,
    CAST(trunc(CAST(pcr1 AS DOUBLE) + (27000000.0::DOUBLE * CAST(pos - pos1 AS DOUBLE)) / ((CAST(pos1 - pos2 AS DOUBLE) * 27.0::DOUBLE / CAST((pcr1 - pcr2 + {PCR_MOD}) % {PCR_MOD} AS DOUBLE)) * 1000000.0::DOUBLE)) AS BIGINT) AS guess FROM r),
t2 AS (SELECT *, CASE WHEN guess IS NULL THEN NULL ELSE (((pcr - guess) % {PCR_MOD}) + {PCR_MOD}) % {PCR_MOD} END AS f FROM s)
SELECT count(*) AS pcrs, count(*) FILTER (WHERE gap > 2700000) AS bad_gaps, max(gap) AS max_gap,
  min(CASE WHEN f > {PCR_MOD // 2} THEN f - {PCR_MOD} ELSE f END) AS min_error, max(CASE WHEN f > {PCR_MOD // 2} THEN f - {PCR_MOD} ELSE f END) AS max_error,
  CAST(floor((CAST(max(pos) - min(pos) AS DOUBLE) * 27000000.0::DOUBLE / CAST(sum(gap) AS DOUBLE)) * 8.0::DOUBLE) AS BIGINT) AS bits_per_second FROM t2"""
)
def pcr_gap_stats(spark, d):
    return packets.pcr_report(S.packets(spark, d)).drop("source")


def _span(k: str) -> str:
    return f"min({k}) AS {k[0]}ts_min, max({k}) AS {k[0]}ts_max, min_by(pos, ({k}, pos)) FILTER (WHERE {k} IS NOT NULL) AS {k[0]}ts_min_pos, max_by(pos, ({k}, -pos)) FILTER (WHERE {k} IS NOT NULL) AS {k[0]}ts_max_pos, CAST(sum({k}) AS BIGINT) // count({k}) AS {k[0]}ts_mean"


@query(
    INTERPOLATED
    + f""", v AS (SELECT *, coalesce(dts, pts) AS d2, acc_pcr // 300 AS t90 FROM timed),
w AS (SELECT *, ((pts - t90 + 12884901888) % 8589934592) - 4294967296 AS pahead, ((d2 - t90 + 12884901888) % 8589934592) - 4294967296 AS dahead FROM v)
SELECT pid, count(*) AS packets, count(*) * 188 AS bytes, count(pts) AS timed, min_by(pts, pos) FILTER (WHERE pts IS NOT NULL) AS first_pts, max_by(pts, pos) FILTER (WHERE pts IS NOT NULL) AS last_pts,
  {_span('pahead')}, {_span('dahead')} FROM w GROUP BY pid"""
)
def buffering_report(spark, d):
    return packets.buffering(S.packets(spark, d)).drop("source")


@query(
    PACKETS
    + """, x AS (SELECT pid, pts, coalesce(dts, pts) AS d, pos FROM packets WHERE pts IS NOT NULL),
y AS (SELECT pid, ((d - lag(d) OVER (PARTITION BY pid ORDER BY pos) + 12884901888) % 8589934592) - 4294967296 AS step, ((pts - d + 12884901888) % 8589934592) - 4294967296 AS ahead FROM x)
SELECT pid, count(*) AS timed, count(*) FILTER (WHERE step <= 0) AS dts_not_later, count(*) FILTER (WHERE ahead < 0) AS pts_before_dts, min(step) AS min_step, max(step) AS max_step FROM y GROUP BY pid"""
)
def dts_monotonic(spark, d):
    return packets.dts_order(S.packets(spark, d)).drop("source")


@query(
    PACKETS
    + """, x AS (SELECT pid, us * 27 AS t, count(*) OVER (PARTITION BY pid ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) * 188 AS b FROM packets),
y AS (SELECT pid, t - min(t) OVER w AS dt, b - min(b) OVER w AS db FROM x WINDOW w AS (PARTITION BY pid ORDER BY t RANGE BETWEEN 583200000000 PRECEDING AND CURRENT ROW))
SELECT pid, max(CASE WHEN dt > 0 THEN CAST(db * 216000000 // dt AS BIGINT) END) AS max_bits_per_second FROM y GROUP BY pid"""
)
def max_rate_window(spark, d):
    x = S.packets(spark, d).withColumn("t", F.col("us") * 27)
    return packets.max_rate(x, "t", window=6 * 3600 * clock.PCR_HZ).drop("source")


@query(PACKETS + ", x AS (SELECT n, pts, lag(pts) OVER (PARTITION BY pid ORDER BY n) AS before FROM packets WHERE pts IS NOT NULL) SELECT n, ((pts - before + 12884901888) % 8589934592) - 4294967296 AS diff, abs(((pts - before + 12884901888) % 8589934592) - 4294967296) AS distance FROM x")
def pts_wrap_diff(spark, d):
    x = S.packets(spark, d).where("pts is not null").withColumn("before", F.lag("pts").over(Window.partitionBy("pid").orderBy("n")))
    return x.select("n", clock.pts_signed_diff(F.col("pts"), F.col("before")).alias("diff"), clock.pts_diff_abs(F.col("pts"), F.col("before")).alias("distance"))


@query(PACKETS + f", x AS (SELECT n, us * 27 % {PCR_MOD} AS a, us * 54 % {PCR_MOD} AS b FROM packets) SELECT n, (a - b + {PCR_MOD}) % {PCR_MOD} AS forward, CASE WHEN (a - b + {PCR_MOD}) % {PCR_MOD} > {PCR_MOD // 2} THEN (a - b + {PCR_MOD}) % {PCR_MOD} - {PCR_MOD} ELSE (a - b + {PCR_MOD}) % {PCR_MOD} END AS nearest FROM x")
def pcr_wrap_diff(spark, d):
    x = S.packets(spark, d)
    a, b = clock.pcr_unsigned_wrap(F.col("us") * 27), clock.pcr_unsigned_wrap(F.col("us") * 54)
    return x.select("n", clock.pcr_unsigned_diff(a, b).alias("forward"), clock.pcr_signed_diff(a, b).alias("nearest"))


@query(PACKETS + ", x AS (SELECT n, pcr, pcr // 27 AS u FROM packets WHERE pcr IS NOT NULL) SELECT n, format('{}:{:02d}:{:02d}.{:04d}', u // 3600000000, u // 60000000 % 60, u // 1000000 % 60, u % 1000000 // 1000) AS hms, (pcr // 27000) || 'ms' AS ms, (pcr // 300) || 't' AS t90, format('{}:{:03d}t', pcr // 300, pcr % 300) AS t27 FROM x")
def timestamp_formats(spark, d):
    x, p = S.packets(spark, d).where("pcr is not null"), F.col("pcr")
    return x.select("n", *[clock.format_time(p, k).alias(name) for k, name in (("hms", "hms"), ("ms", "ms"), ("90", "t90"), ("27", "t27"))])


@query(PACKETS + ", x AS (SELECT n, lag(n) OVER (ORDER BY n) AS after FROM packets WHERE pcr IS NOT NULL) SELECT after, n, n - coalesce(after, -1) AS packets FROM x WHERE n - coalesce(after, -1) > 8")
def far_pcrs(spark, d):
    return packets.far_pcrs(S.packets(spark, d), 8).drop("source")


@query(PACKETS + ", tt AS (SELECT max(n) + 1 AS total FROM packets), kk AS (SELECT unnest(range(3)) AS k) SELECT n + k * total AS n, pos + k * total * 188 AS pos, pid, CAST(k AS INTEGER) AS loop FROM packets, tt, kk")
def packet_loop(spark, d):
    return packets.repeat(S.packets(spark, d), 3).select("n", "pos", "pid", "loop")


@query()
def pacing_by_credit(spark, d):
    return packets.schedule_by_credit(S.packets(spark, d)).select("item", "send_us")


# a clock that drifts by 7919 a row is set anew at each 26th
@query(PACKETS + "SELECT n, (n - (SELECT min(n) FROM packets)) % 26 * 7919 AS late, (n - (SELECT min(n) FROM packets)) % 26 = 0 AND n > (SELECT min(n) FROM packets) AS reset FROM packets")
def late_times(spark, d):
    x = S.packets(spark, d).select("source", "n", (F.col("n") * 10).alias("send_us"), (F.col("n") * 7929).alias("now_us"))
    return packets.waits(x).select("n", F.col("late_us").alias("late"), "reset")


@query(PACKETS + "SELECT n // 1000 AS stretch, count(*) AS rows, CAST(sum(count(*)) OVER (ORDER BY n // 1000) AS BIGINT) AS total FROM packets GROUP BY n // 1000")
def progress_counts(spark, d):
    return reports.progress(S.packets(spark, d), 1000).select((F.expr("upto div 1000") - 1).alias("stretch"), "rows", "total")


# --- program tables ------------------------------------------------------------------------------


@query(TABLES + "SELECT DISTINCT program_number, pmt_pid, stream_type, elementary_pid FROM programs JOIN streams USING (pmt_pid) WHERE program_number <> 0")
def pat_pmt_join(spark, d):
    return tables.program_streams(S.programs(spark, d), S.streams(spark, d)).select("program_number", "pmt_pid", "stream_type", "elementary_pid")


@query(TABLES + ", " + PACKETS.replace("WITH ", "", 1).strip() + " SELECT p.n, p.pid, s.stream_type FROM packets p LEFT JOIN (SELECT elementary_pid, min_by(stream_type, pos) AS stream_type FROM streams GROUP BY 1) s ON p.pid = s.elementary_pid")
def pid_stream_type_left_join(spark, d):
    return tables.with_stream_type(S.packets(spark, d), S.streams(spark, d)).select("n", "pid", "stream_type")


@query(TABLES + "SELECT program_number, pmt_pid FROM programs WHERE program_number <> 0 ORDER BY pos, program_number LIMIT 1 OFFSET 1")
def program_select_nth(spark, d):
    return tables.select_program(S.programs(spark, d), index=2).select("program_number", "pmt_pid")


@query(TABLES + ", " + PACKETS.replace("WITH ", "", 1).strip() + " SELECT pid, count(*) AS packets FROM packets WHERE pid NOT IN (SELECT elementary_pid FROM streams) GROUP BY pid")
def unknown_pids(spark, d):
    return tables.unknown_pids(S.packets(spark, d), S.streams(spark, d)).drop("source")


@query(TABLES + ", p AS (SELECT program_number, pmt_pid FROM programs WHERE program_number <> 0 ORDER BY pos, program_number LIMIT 1 OFFSET 1) SELECT program_number, min_by(elementary_pid + 1, pos) AS pcr_pid FROM p JOIN streams USING (pmt_pid) GROUP BY program_number")
def pcr_pid_of_program(spark, d):
    streams = S.streams(spark, d).withColumn("pcr_pid", F.col("elementary_pid") + 1)
    return tables.pcr_pid(S.programs(spark, d), streams, index=2).drop("source")


@query(TABLES + "SELECT pos, CASE WHEN program_number = 0 THEN printf('Network information on PID %04X', pmt_pid) ELSE printf('Program %d: map on PID %04X', program_number, pmt_pid) END AS text FROM programs")
def program_lines(spark, d):
    return reports.program_lines(S.programs(spark, d)).drop("source")


@query(TABLES + "SELECT pos, 0 AS line, printf('Program %d, version 3, PCR on PID %04X, streams: 1', program_number, elementary_pid) AS text FROM streams JOIN programs USING (pmt_pid, pos) UNION ALL SELECT pos, 0, printf('Program %d, version 3, PCR on PID %04X, streams: 1', pmt_pid - 32, elementary_pid) FROM streams WHERE pos NOT IN (SELECT pos FROM programs p WHERE p.pmt_pid = streams.pmt_pid)")
def table_heads(spark, d):
    streams = S.streams(spark, d).withColumns({"pcr_pid": F.col("elementary_pid"), "version": F.lit(3), "es_info": F.unhex(F.lit(""))})
    return reports.table_lines(streams).where("line = 0").select("pos", "line", "text")


@query(TABLES + "SELECT min_by(elementary_pid, pos) FILTER (WHERE stream_type IN (1, 2, 27, 36, 66, 16)) AS video_pid, min_by(elementary_pid, pos) FILTER (WHERE stream_type IN (3, 4, 15, 17, 6, 129)) AS audio_pid FROM streams")
def choose_av_pids(spark, d):
    return tables.choose_pids(S.streams(spark, d)).drop("source")


@query(TABLES + "SELECT elementary_pid, stream_type IN (1, 2, 27, 36, 66, 16) AS video, stream_type IN (3, 4, 15, 17, 6, 129) AS audio FROM streams")
def stream_kind_predicates(spark, d):
    s = F.col("stream_type")
    return S.streams(spark, d).select("elementary_pid", codes.is_video_type(s).alias("video"), codes.is_audio_type(s).alias("audio"))


@query("WITH x AS (SELECT o_custkey + 32 AS pmt_pid, o_orderkey AS pos, o_orderpriority AS v, lag(o_orderpriority) OVER w AS b, row_number() OVER w AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT pmt_pid, pos, v AS version FROM x WHERE rn = 1 OR v IS DISTINCT FROM b")
def pmt_change_detect(spark, d):
    x = S.table(spark, d, "orders").select(F.lit("orders").alias("source"), (F.col("o_custkey") + 32).alias("pmt_pid"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("version"))
    return tables.table_changes(x, F.col("version")).drop("source")


@query("SELECT o_custkey + 32 AS pmt_pid, o_orderkey AS pos, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS until FROM orders")
def pmt_validity(spark, d):
    x = S.table(spark, d, "orders").select(F.lit("orders").alias("source"), (F.col("o_custkey") + 32).alias("pmt_pid"), F.col("o_orderkey").alias("pos"))
    return tables.validity(x).drop("source")


# --- PES and sections ----------------------------------------------------------------------------

ISLANDS = "WITH x AS (SELECT *, lag(role) OVER w IS DISTINCT FROM role AS start FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), y AS (SELECT *, sum(CASE WHEN start THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM x) "


@query(ISLANDS + "SELECT conv_id, CAST(island AS BIGINT) AS island, count(*) AS packets, CAST(sum(strlen(text)) AS BIGINT) AS bytes, sha256(string_agg(text, '' ORDER BY turn)) AS digest FROM y GROUP BY conv_id, island")
def pes_reassembly(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = S.table(spark, d, "conversations").withColumn("start", ~F.lag("role").over(w).eqNullSafe(F.col("role")))
    x = packets.islands(x, ["conv_id"], "turn", F.col("start"))
    joined = elementary.concat_ordered(F.col("turn"), F.col("text").cast("binary"))
    return x.groupBy("conv_id", F.col("island").cast("long").alias("island")).agg(F.count("*").alias("packets"), F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.sha2(joined, 256).alias("digest"))


# --- frames --------------------------------------------------------------------------------------


@query(FRAMES + "SELECT kind, count(*) AS frames, min(size) AS min_size, max(size) AS max_size, CAST(sum(size) // count(*) AS BIGINT) AS mean_size, CAST(sum(size) AS BIGINT) AS total_size FROM frames GROUP BY ROLLUP (kind)")
def frame_size_by_type(spark, d):
    return frames.sizes_by_kind(S.frames(spark, d))


@query(FRAMES + "SELECT slice_class, count(*) FILTER (WHERE category = 'idr') AS idr, count(*) FILTER (WHERE category = 'reference') AS reference, count(*) FILTER (WHERE category = 'other') AS other FROM frames GROUP BY slice_class")
def frame_category_slice_pivot(spark, d):
    return frames.category_by_slices(S.frames(spark, d), ["idr", "reference", "other"])


@query(FRAMES + "SELECT 'ref_idc' AS measure, ref_idc AS value, count(*) AS units FROM frames GROUP BY ref_idc UNION ALL SELECT 'unit_type', CASE WHEN unit_type BETWEEN 13 AND 23 THEN 13 WHEN unit_type >= 24 THEN 24 ELSE unit_type END AS v, count(*) FROM frames GROUP BY v UNION ALL SELECT 'slice_type', slice_type, count(*) FROM frames GROUP BY slice_type")
def nal_histogram_grouping_sets(spark, d):
    return frames.unit_histograms(S.frames(spark, d))


@query(FRAMES + ", x AS (SELECT source, idx, coalesce(last_value(afd IGNORE NULLS) OVER (PARTITION BY source ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS afd FROM frames), y AS (SELECT *, coalesce(lag(afd) OVER (PARTITION BY source ORDER BY idx), 0) AS b FROM x) SELECT source, idx, afd FROM y WHERE afd <> b")
def afd_changes(spark, d):
    return frames.afd_changes(S.frames(spark, d).dropDuplicates(["source", "idx"]).select("source", "idx", "afd"))


GOPS = FRAMES + ", x AS (SELECT source, sum(CASE WHEN kind = 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY idx) AS gop, size FROM frames), g AS (SELECT source, gop, count(*) AS frames, sum(size) AS bytes FROM x WHERE gop > 0 GROUP BY source, gop) "


@query(GOPS + "SELECT source, count(*) AS gops, min(frames) AS min_frames, max(frames) AS max_frames, CASE WHEN count(*) > 1 THEN sum(frames) / count(*) END AS mean_frames FROM g GROUP BY source")
def gop_stats(spark, d):
    return frames.gop_report(S.frames(spark, d), F.col("kind") == "I")


MARK = "CASE WHEN idr THEN 'D' ELSE (CASE WHEN ref THEN upper(l) ELSE lower(l) END) END"


@query(FRAMES + f", x AS (SELECT source, idx, (row_number() OVER (PARTITION BY source ORDER BY idx) - 1) // 5 AS line, CASE slice_class WHEN 'mixed' THEN 'X' ELSE slice_class END AS l, idr, ref FROM frames) SELECT source, line, string_agg({MARK}, '' ORDER BY idx) AS dots FROM x GROUP BY source, line")
def dots_string(spark, d):
    return frames.dots(S.frames(spark, d), frames.avc_mark(F.col("ref"), F.col("idr"), F.col("slice_class"), F.lit(True)), 5)


@query(FRAMES + "SELECT source, idx, size FROM frames WHERE idr OR (ref AND slice_class = 'I')")
def strip_reference_frames(spark, d):
    return frames.strip_to_reference(S.frames(spark, d)).select("source", "idx", "size")


@query(FRAMES + ", h AS (SELECT source, idx, slice_type AS c, lag(slice_type) OVER w AS b, row_number() OVER w AS rn FROM frames WHERE kind = 'I' WINDOW w AS (PARTITION BY source ORDER BY idx)) SELECT source, idx, c AS content FROM h WHERE rn = 1 OR c <> b UNION ALL SELECT source, idx, slice_type FROM frames WHERE kind <> 'I'")
def seq_header_dedupe(spark, d):
    x = S.frames(spark, d).select("source", "idx", F.col("slice_type").alias("content"), (F.col("kind") == "I").alias("is_header"))
    return frames.drop_repeated_headers(x).select("source", "idx", "content")


@query(FRAMES + ", x AS (SELECT source, idx, row_number() OVER (PARTITION BY source ORDER BY idx DESC) - 1 AS r FROM frames) SELECT source, idx, r // 2 + 1 AS out_no FROM x WHERE r % 2 = 0")
def reverse_every_n(spark, d):
    return frames.reverse(S.frames(spark, d), 2).select("source", "idx", F.col("out_no").cast("long").alias("out_no"))


@query(FRAMES + ", f AS (SELECT source, min(idx) AS t FROM frames WHERE ref GROUP BY source) SELECT frames.source, idx FROM frames JOIN f ON frames.source = f.source AND idx <= t")
def up_to_reference(spark, d):
    return frames.up_to_reference(S.frames(spark, d)).select("source", "idx")


# in DuckDB a recursion over the place of the last picture taken
EVERY = FRAMES.replace("WITH l AS", "WITH RECURSIVE l AS", 1) + """, f AS MATERIALIZED (SELECT source, idx FROM frames WHERE ref),
taken AS (SELECT source, min(idx) AS idx FROM f GROUP BY source UNION ALL SELECT f.source, min(f.idx) FROM taken JOIN f ON f.source = taken.source AND f.idx - taken.idx >= 3 GROUP BY f.source)
SELECT source, idx, coalesce(CAST((lead(idx) OVER (PARTITION BY source ORDER BY idx) - idx) // 3 AS BIGINT), 1) AS repeats FROM taken"""


@query(EVERY)
def keep_every_n(spark, d):
    return frames.keep_every(S.frames(spark, d).where("ref"), 3)


@query(EVERY.replace("WHERE ref", "WHERE ref AND idx < 3000000000000"))
def filter_first_items(spark, d):
    x = S.frames(spark, d).where("idx < 3000000000000").dropDuplicates(["source", "idx"])
    return frames.act(x, "filter", 3)


@query(FRAMES + ", x AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY idx) AS rn FROM (SELECT DISTINCT source, idx, idr OR (ref AND slice_class = 'I') AS kept FROM frames)) SELECT source, idx, 1::BIGINT AS repeats FROM x WHERE rn <= 2 AND kept")
def strip_first_items(spark, d):
    return frames.act(S.frames(spark, d).dropDuplicates(["source", "idx"]), "strip", limit=2)


@query(PACKETS + ", x AS (SELECT us AS time, 0 AS kind, size FROM packets WHERE kind = 'view' UNION ALL SELECT us, 1, size FROM packets WHERE kind = 'click') SELECT time, kind, size, row_number() OVER (ORDER BY time, kind, size) AS out_no FROM x")
def av_merge_by_pts(spark, d):
    x = S.packets(spark, d).select("source", F.col("us").alias("time"), "size", F.col("kind").alias("k"))
    return frames.merge_by_time(x.where("k = 'view'"), x.where("k = 'click'")).select("time", "kind", "size", F.col("out_no").cast("long").alias("out_no"))


# --- captures ------------------------------------------------------------------------------------

KEY = "vlan, dst_ip, dst_port"


@query(CAPTURE + f"SELECT {KEY}, min(pkt_no) AS first_pkt, count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (WHERE size % 188 = 0) AS good, count(*) FILTER (WHERE size % 188 <> 0) AS dodgy, min_by(ssrc, pkt_no) AS first_ssrc, count(DISTINCT ssrc) > 1 AS several_ssrc, bit_or(CAST(1 << pcp AS INTEGER)) AS pcp_bits, row_number() OVER (ORDER BY min(pkt_no)) - 1 AS stream_no FROM capture GROUP BY {KEY}")
def capture_stream_stats(spark, d):
    x = captures.number_streams(captures.stream_report(S.capture(spark, d))).drop("source")
    return x.withColumn("stream_no", F.col("stream_no").cast("long"))


@query(CAPTURE + f", x AS (SELECT {KEY}, bit_or(CAST(1 << pcp AS INTEGER)) AS b FROM capture GROUP BY {KEY}) SELECT {KEY}, array_to_string(list_filter(range(16), lambda i: (b >> i) & 1 = 1), ',') AS pcps FROM x")
def vlan_bitmap(spark, d):
    x = captures.stream_report(S.capture(spark, d))
    return x.select("vlan", "dst_ip", "dst_port", F.array_join(bits.set_bits(F.col("pcp_bits")).cast("array<string>"), ",").alias("pcps"))


@query(CAPTURE + f", x AS (SELECT *, lag(seq) OVER (PARTITION BY {KEY} ORDER BY pkt_no) AS b FROM capture) SELECT pkt_no, (seq - b - 1 + 65536) % 65536 AS gap FROM x WHERE (seq - b - 1 + 65536) % 65536 > 0")
def rtp_seq_gap(spark, d):
    return captures.sequence_gaps(S.capture(spark, d)).select("pkt_no", "gap")


SECTIONS = CAPTURE + f", x AS (SELECT *, lag(t90) OVER (PARTITION BY {KEY} ORDER BY pkt_no) AS b FROM capture), s AS (SELECT *, sum(CASE WHEN abs(t90 - b) > 1944000000 THEN 1 ELSE 0 END) OVER (PARTITION BY {KEY} ORDER BY pkt_no) AS section FROM x) "


@query(SECTIONS + f"SELECT {KEY}, CAST(section AS BIGINT) AS section, count(*) AS packets FROM s GROUP BY {KEY}, section")
def section_split(spark, d):
    x = captures.sections(S.capture(spark, d), 1944000000)
    return x.groupBy("vlan", "dst_ip", "dst_port", F.col("section").cast("long").alias("section")).agg(F.count("*").alias("packets"))


@query(
    SECTIONS
    + f""", r AS (SELECT {KEY}, CAST(section AS BIGINT) AS section, count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes, max_by(t90, pkt_no) - min_by(t90, pkt_no) AS time_span, ((max_by(pcr90, pkt_no) - min_by(pcr90, pkt_no) + 12884901888) % 8589934592) - 4294967296 AS clock_span FROM s GROUP BY {KEY}, section)
SELECT *, clock_span - time_span AS drift, CASE WHEN time_span > 0 THEN CAST((clock_span - time_span) * 5400000 // time_span AS BIGINT) END AS drift_per_minute, CASE WHEN time_span > 0 THEN bytes * 720000 // time_span END AS bits_per_second FROM r"""
)
def drift_per_section(spark, d):
    x = captures.sections(S.capture(spark, d), 1944000000).withColumn("section", F.col("section").cast("long"))
    return captures.section_report(x).drop("source")


def _near(d: str) -> str:
    return f"((({d}) + 12884901888) % 8589934592 - 4294967296)"


SKEW = f"{_near('s.pcr90 - r.p0')} - (s.t90 - r.t0)"


@query(
    CAPTURE.replace("WITH e AS", "WITH RECURSIVE e AS", 1)
    + f""", s AS MATERIALIZED (SELECT {KEY}, pkt_no, t90, pcr90, row_number() OVER (PARTITION BY {KEY} ORDER BY pkt_no) AS rn FROM capture),
r AS (
  SELECT {KEY}, rn, pkt_no, t90 AS t0, pcr90 AS p0, t90, pcr90, 0 AS section, 0::BIGINT AS skew FROM s WHERE rn = 1
  UNION ALL
  SELECT vlan, dst_ip, dst_port, rn, pkt_no, CASE WHEN cut THEN t90 ELSE t0 END, CASE WHEN cut THEN pcr90 ELSE p0 END, t90, pcr90, section + CASE WHEN cut THEN 1 ELSE 0 END, CASE WHEN cut THEN 0 ELSE skew END
  FROM (SELECT s.*, r.t0, r.p0, r.section, {SKEW} AS skew, abs(s.t90 - r.t90) > 1944000000 OR abs({_near('s.pcr90 - r.pcr90')}) > 1944000000 OR {SKEW} > 1944000000 AS cut
    FROM r JOIN s ON s.vlan = r.vlan AND s.dst_ip = r.dst_ip AND s.dst_port = r.dst_port AND s.rn = r.rn + 1))
SELECT pkt_no, section, skew FROM r"""
)
def section_split_by_skew(spark, d):
    return captures.sections_by_skew(S.capture(spark, d), 1944000000).select("pkt_no", "section", "skew")


@query(CAPTURE + f", x AS (SELECT pkt_no, vlan, dst_ip, dst_port, t90, (pcr90 - t90) % 1000 AS s FROM capture) SELECT pkt_no, max(s) OVER w - min(s) OVER w AS jitter FROM x WINDOW w AS (PARTITION BY {KEY} ORDER BY t90 RANGE BETWEEN 900000000 PRECEDING AND CURRENT ROW)")
def jitter_window(spark, d):
    return captures.jitter(S.capture(spark, d), (F.col("pcr90") - F.col("t90")) % 1000, 900_000_000).select("pkt_no", "jitter")


# --- conversion ----------------------------------------------------------------------------------


@query("SELECT l_orderkey AS pos, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS out_no FROM lineitem")
def m2ts_reorder(spark, d):
    x = S.table(spark, d, "lineitem").select(F.lit("l").alias("source"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("pos"), F.col("l_shipdate").alias("stamp"))
    return packets.reorder(x, "stamp").select(F.col("pos.l_orderkey").alias("pos"), F.col("out_no").cast("long").alias("out_no"))


@query("WITH t AS (SELECT count(*) AS n FROM events) SELECT event_id AS n, 1 AS kind FROM events UNION ALL SELECT CAST(trunc(f * n) AS BIGINT), 0 FROM t, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) v(f)")
def packet_insert_fraction(spark, d):
    x = S.packets(spark, d)
    return packets.insert_at(x, [0.25, 0.5, 0.9], x.count())


@query(PACKETS + "SELECT n, n // 7 AS item, n // 7 * 7 * 188 * 1000000 // 250000 AS send_us FROM packets")
def pacing_schedule(spark, d):
    return packets.schedule(S.packets(spark, d)).select("n", "item", "send_us")


@query(
    INTERPOLATED
    + f""", u AS (SELECT n, coalesce((acc_pcr - lag(acc_pcr) OVER (ORDER BY n) + {PCR_MOD}) % {PCR_MOD}, 0) AS f FROM timed),
v AS (SELECT n, CASE WHEN f > {PCR_MOD // 2} THEN f - {PCR_MOD} ELSE f END AS step FROM u),
w AS (SELECT n, sum(step) OVER (ORDER BY n) AS clock, sum(CASE WHEN step > 54000000 OR step < 0 THEN 1 ELSE 0 END) OVER (ORDER BY n) AS epoch FROM v)
SELECT n, CAST(epoch AS BIGINT) AS epoch, CAST((clock - first_value(clock) OVER (PARTITION BY epoch ORDER BY n)) // 27 AS BIGINT) AS send_us FROM w"""
)
def pacing_by_pcr(spark, d):
    return packets.schedule_by_pcr(S.packets(spark, d)).select("n", "epoch", "send_us")


@query("SELECT page_id, CAST(len(string_split(html, '<p')) - 1 AS BIGINT) AS units, CAST(strlen(html) - strlen(string_split(html, '<p')[1]) AS BIGINT) AS bytes FROM pages WHERE contains(html, '<p')")
def start_code_units(spark, d):
    x = S.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("source"), F.lit(0).cast("long").alias("infile"), F.col("html").cast("binary").alias("data"))
    u = elementary.split_units(x, b"<p")
    return u.groupBy(F.col("source").cast("long").alias("page_id")).agg(F.count("*").alias("units"), F.sum(F.octet_length("data").cast("long")).alias("bytes"))


@query("SELECT p_partkey, hex(encode(p_name)) || '0000' || printf('%02X', p_size % 6) || '01' AS data FROM part")
def emulation_round_trip(spark, d):
    # a byte of 3 or less after two zeros is escaped
    escape = F.when(F.col("p_size") % 6 <= 3, F.unhex(F.lit("03"))).otherwise(F.unhex(F.lit("")))
    data = F.concat(F.col("p_name").cast("binary"), F.unhex(F.lit("0000")), escape, bits.be(F.col("p_size") % 6, 1), F.unhex(F.lit("01")))
    return S.table(spark, d, "part").select("p_partkey", F.hex(bits.remove_emulation_prevention(data)).alias("data"))


@query(PACKETS + "SELECT n, pts FROM packets WHERE pts IS NOT NULL")
def pts_round_trip(spark, d):
    x = S.packets(spark, d).where("pts is not null")
    return x.select("n", elementary.decode_pts(elementary.encode_pts(F.col("pts"), 2), 2)["value"].alias("pts"))


@query(PACKETS + "SELECT n, pid, cc, disc, pcr FROM packets")
def packet_round_trip(spark, d):
    # a PID has 13 bits, so further ones go to further streams
    raw = transport.build(S.in_streams(S.packets(spark, d)).withColumn("payload", F.lit(b"abc")))
    x = transport.parse(raw.select("source", "n", "pos", "raw"))
    return x.select("n", S.pid_of(F.col("source"), F.col("pid")).alias("pid"), F.col("cc").cast("long").alias("cc"), "disc", "pcr")


@query("SELECT p_partkey, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(bin(p_name), ''), lambda b: CAST(b AS UBIGINT))), lambda c, b: xor((c * 2) & 4294967295::UBIGINT, CASE WHEN (c >> 31) <> b THEN 79764919::UBIGINT ELSE 0::UBIGINT END))::BIGINT AS crc FROM part")
def crc32_mpeg(spark, d):
    return S.table(spark, d, "part").select("p_partkey", bits.crc32_mpeg(F.col("p_name").cast("binary")).alias("crc"))


@query(
    """WITH RECURSIVE g AS (
  SELECT p_partkey, bin(p_name) AS s, 0 AS k, '' AS found FROM part
  UNION ALL
  SELECT p_partkey, substr(s, 2 * z + 2), k + 1, found || CASE WHEN k > 0 THEN ',' ELSE '' END || (list_reduce(list_transform(string_split(substr(s, z + 1, z + 1), ''), lambda b: CAST(b AS BIGINT)), lambda a, b: 2 * a + b) - 1)
  FROM (SELECT *, instr(s, '1') - 1 AS z FROM g) WHERE k < 4 AND z >= 0 AND length(s) >= 2 * z + 1)
SELECT p_partkey, max_by(found, k) AS found FROM g GROUP BY p_partkey"""
)
def exp_golomb_decode(spark, d):
    values = bits.exp_golomb(F.col("p_name").cast("binary"), F.lit(4))
    return S.table(spark, d, "part").select("p_partkey", F.array_join(values.cast("array<string>"), ",").alias("found"))


@query("SELECT CAST(conv_id AS VARCHAR) AS source, sha256(string_agg(text, '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def es_transport_round_trip(spark, d):
    x = S.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("source"), F.col("turn").alias("start"), F.col("text").cast("binary").alias("data"))
    parsed = transport.parse(transport.lay_out(convert.es_to_transport(x)))
    es = convert.extract_first(parsed)
    return es.groupBy("source").agg(F.sha2(elementary.concat_ordered(F.col("pos"), F.col("es_data")), 256).alias("digest"))


@query("SELECT CASE WHEN o_custkey % 3 = 0 THEN 'video' ELSE 'audio' END AS kind, CAST(o_custkey % 3 AS INTEGER) AS number, count(*) AS packets, min(length(o_orderpriority)) + 9 AS min_len, max(length(o_orderpriority)) + 9 AS max_len, (sum(length(o_orderpriority) + 9) // count(*))::BIGINT AS mean_len FROM orders GROUP BY o_custkey % 3")
def ps_stream_sizes(spark, d):
    return files.stream_sizes(files.substreams(files.program_packets(S.program_stream_chunks(spark, d)))).drop("source").withColumns({c: F.col(c).cast("long") for c in ("min_len", "max_len")})


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'v' ELSE 'a' || (o_custkey % 3) END AS mark, row_number() OVER (ORDER BY o_orderkey) AS packet FROM orders")
def ps_packets_in_order(spark, d):
    x = files.program_packets(S.program_stream_chunks(spark, d)).where("stream_id <> 186")
    own = places.number(x.select("source", "pos", "stream_id"), ["source"], F.col("pos"), ["pos"], "packet").select("packet", reports.ps_mark(F.col("stream_id")).alias("mark"))
    keys = places.number(S.table(spark, d, "orders").select("o_orderkey"), [], F.col("o_orderkey"), ["o_orderkey"], "packet")
    return own.join(keys, "packet").select("o_orderkey", "mark", (F.col("packet") + 1).alias("packet"))


@query("WITH x AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 10 + 1 AS pack, o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'v' ELSE 'a' || (o_custkey % 3) END AS mark FROM orders) SELECT pack, '[' || string_agg(mark, '' ORDER BY o_orderkey) AS dots FROM x GROUP BY pack")
def ps_dots(spark, d):
    return reports.ps_dots(files.program_packets(S.program_stream_chunks(spark, d))).select(F.col("pack").cast("long").alias("pack"), "dots")


@query(PACKETS + "SELECT row_number() OVER (ORDER BY n) - 1 AS pkt_no, us // 1000000 * 90000 + us % 1000000 * 9 // 100 AS t90, pid - 256 + 167772160 AS dst_ip, CAST((pid - 256) % 4 + 5000 AS BIGINT) AS dst_port, kind AS payload FROM packets")
def capture_bytes(spark, d):
    x = files.capture_packets(S.capture_file_chunks(spark, d))
    return x.select("pkt_no", "t90", "dst_ip", F.col("dst_port").cast("long").alias("dst_port"), F.decode("payload", "utf-8").alias("payload"))


@query(PACKETS + "SELECT row_number() OVER (ORDER BY n) - 1 AS n, us % 4294967296 AS stamp, CAST(pid AS BIGINT) AS pid FROM packets")
def stamped_bytes(spark, d):
    x = records.cut_records(S.stamped_chunks(spark, d), 192)
    # packets of several streams lie in one file; each tells its stream in its payload
    return x.select("n", bits.uint(F.col("raw"), 0, 4).alias("stamp"), S.pid_of(bits.uint(F.col("raw"), 8, 4), bits.uint(F.col("raw"), 5, 2).bitwiseAND(0x1FFF)).alias("pid"))


@query("SELECT o_orderkey AS pos, 0 AS part, 'first ' || o_orderpriority AS body FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT o_orderkey, 1, 'frame' FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT o_orderkey, 0, 'first ' || o_orderpriority || 'frame' FROM orders WHERE o_custkey % 2 = 1")
def dvd_ac3_unpack(spark, d):
    first = F.concat(F.lit("first "), "o_orderpriority").cast("binary")
    offset = F.when(F.col("o_custkey") % 2 == 0, F.length(first) + 1).otherwise(1)
    body = F.concat(F.unhex(F.lit("8001")), bits.be(offset, 2), first, F.lit("frame").cast("binary"))
    data = F.concat(transport.pes_header(0xBD, F.length(body), F.col("o_orderkey")), body)
    x = S.table(spark, d, "orders").select(F.lit("f").alias("source"), F.col("o_orderkey").alias("pos"), F.lit(0xBD).alias("stream_id"), data.alias("data"))
    es = transport.decode_pes(convert.dvd_ac3(x).drop("stream_id"))
    return es.select("pos", "part", F.decode("es_data", "utf-8").alias("body"))


_TYPE_CASES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in codes.STREAM_TYPES.items())


@query(f"SELECT p_partkey, p_size * 5 AS stream_type, CASE p_size * 5 {_TYPE_CASES} ELSE CASE WHEN p_size * 5 BETWEEN 29 AND 125 THEN '13818-1 reserved' WHEN p_size * 5 BETWEEN 128 AND 255 THEN 'User private' ELSE 'Unrecognised' END END AS text FROM part")
def stream_type_names(spark, d):
    t = F.col("p_size") * 5
    return S.table(spark, d, "part").select("p_partkey", t.alias("stream_type"), codes.stream_type_text(t).alias("text"))


@query("WITH x AS (SELECT c_custkey, c_custkey * 65537 % 4294967296 AS v FROM customer) SELECT c_custkey, format('{}.{}.{}.{}', v // 16777216, v // 65536 % 256, v // 256 % 256, v % 256) AS ip, v AS value FROM x")
def ipv4_round_trip(spark, d):
    v = F.col("c_custkey") * 65537 % 4294967296
    x = S.table(spark, d, "customer").select("c_custkey", bits.ipv4_text(v).alias("ip"))
    return x.select("c_custkey", "ip", bits.ipv4_value(F.col("ip")).alias("value"))


COMMANDS = [("n", 50), ("f", 40), ("r", 20), (">", 30), ("F", 20), ("R", 10), ("n", 25)]


def _trick_sql(commands) -> str:
    """The plan of a list of commands, a few tables for each."""
    sql = PACKETS + ", x AS MATERIALIZED (SELECT n AS idx, kind = 'view' AS ref, row_number() OVER (ORDER BY n) - 1 AS o FROM packets), a0 AS (SELECT 0 AS here)"
    reverse, shown = False, []
    for i, (c, count) in enumerate(commands):
        at = f"a{i}"
        if c in "><][":
            jump = {">": 250, "<": -250, "]": 4500, "[": -4500}[c]
            sql += f", j{i} AS (SELECT greatest(0, least((SELECT max(o) FROM x), here + ({jump}))) AS here FROM {at})"
            at, c, reverse = f"j{i}", "n", True
        back, every = c in "rR", 8 if c in "FR" else 1
        where = f"o <= (SELECT here FROM {at}) AND ref" if back else f"o >= (SELECT here FROM {at})"
        if c in "fF":
            where += " AND ref"
        elif reverse and not back:
            where += f" AND o >= (SELECT min(o) FROM x WHERE ref AND o >= (SELECT here FROM {at}))"
        sql += f", r{i} AS (SELECT idx, o, row_number() OVER (ORDER BY o {'DESC' if back else 'ASC'}) AS k FROM x WHERE {where}), s{i} AS (SELECT idx, o, (k - 1) // {every} + 1 AS out_no FROM r{i} WHERE k <= {(count - 1) * every + 1} AND (k - 1) % {every} = 0)"
        end = "min(o)" if back else "max(o) + 1"
        sql += f", a{i + 1} AS (SELECT coalesce((SELECT {end} FROM s{i}), here) AS here FROM {at})"
        shown.append(f"SELECT {i} AS step, out_no, idx FROM s{i}")
        reverse = back
    return sql + ", plan AS (" + " UNION ALL ".join(shown) + ") "


@query(_trick_sql(COMMANDS) + "SELECT 'events' AS source, CAST(step AS INTEGER) AS step, out_no, idx FROM plan")
def trick_play(spark, d):
    x = S.packets(spark, d).select("source", F.col("n").alias("idx"), (F.col("kind") == "view").alias("ref"))
    return trickplay.plan(x, COMMANDS)


@query(_trick_sql(COMMANDS) + "SELECT sha256(string_agg(kind || idx, '' ORDER BY step, out_no)) AS digest, count(*) AS pictures FROM plan JOIN packets ON idx = n")
def trick_play_bytes(spark, d):
    x = S.packets(spark, d).select("source", F.col("n").alias("idx"), (F.col("kind") == "view").alias("ref"), F.concat("kind", F.col("n").cast("string")).cast("binary").alias("data"))
    shown = frames.shown(trickplay.plan(x, COMMANDS), x)
    return shown.groupBy().agg(F.sha2(elementary.concat_ordered(F.col("order"), F.col("data")), 256).alias("digest"), F.count("*").alias("pictures"))


@query()
def av_multiplex(spark, d):
    x = S.packets(spark, d).select("source", F.col("n").alias("idx"), "kind", F.encode(F.col("kind"), "utf-8").alias("data"))
    return transport.lay_out(convert.merge_av(x.where("kind = 'view'"), x.where("kind = 'click'"))).select("n", "pos", F.hex("raw").alias("raw"))


ORDINAL = PACKETS + ", o AS (SELECT CAST(pid AS VARCHAR) AS source, n, kind, row_number() OVER (PARTITION BY pid ORDER BY n) AS rn FROM packets) "


@query(ORDINAL + "SELECT source, rn AS idx, CASE kind WHEN 'view' THEN 'I' WHEN 'click' THEN 'P' ELSE 'B' END AS slice_class, kind IN ('view', 'click') AS ref, CAST(rn % 16 AS INTEGER) AS frame_num, 1::BIGINT AS slices FROM o")
def h264_access_units(spark, d):
    nals = elementary.nal_units(elementary.es_units(S.h264_chunks(spark, d)))
    au = elementary.non_empty(elementary.access_units(elementary.slice_headers(nals)))
    return au.select("source", F.col("idx").cast("long").alias("idx"), "slice_class", "ref", "frame_num", "slices")


@query(ORDINAL + "SELECT source, count(*) AS units, 1::BIGINT AS sps, 1::BIGINT AS pps, count(*) FILTER (WHERE kind IN ('view', 'click')) AS reference_slices FROM o GROUP BY source")
def h264_units(spark, d):
    nals = elementary.nal_units(elementary.es_units(S.h264_chunks(spark, d)))
    is_slice = F.col("unit_type") == 1
    return nals.groupBy("source").agg(F.count_if(is_slice).alias("units"), F.count("sps").alias("sps"), F.count("pps").alias("pps"), F.count_if(is_slice & (F.col("ref_idc") > 0)).alias("reference_slices"))


@query(ORDINAL + "SELECT source, n AS place, CASE kind WHEN 'view' THEN 'I' WHEN 'click' THEN 'P' ELSE 'B' END AS kind, rn % 1024 AS temporal_reference, 1::BIGINT AS slices FROM o")
def h262_pictures(spark, d):
    items = elementary.h262_items(elementary.es_units(S.h262_chunks(spark, d)))
    pics = elementary.h262_pictures(items).where("is_picture")
    rn = F.row_number().over(Window.partitionBy("source").orderBy("start"))
    place = S.packets(spark, d).select(F.col("pid").cast("string").alias("p"), F.col("n").alias("place"), F.row_number().over(Window.partitionBy("pid").orderBy("n")).alias("k"))
    x = pics.withColumn("rn", rn)
    return x.join(place, (F.col("source") == F.col("p")) & (F.col("rn") == F.col("k"))).select("source", "place", "kind", "temporal_reference", "slices")


@query("SELECT CAST(user_id + 256 AS VARCHAR) AS source, 'H.264' AS video, CASE WHEN count(*) FILTER (WHERE event_type = 'view') > 0 THEN 'unknown' ELSE 'H.264' END AS other FROM events GROUP BY user_id")
def video_type_vote(spark, d):
    own = elementary.video_type(elementary.es_units(S.h264_chunks(spark, d))).select("source", "video")
    # a sequence header rules H.264 out, and leaves the two other kinds open
    other = elementary.video_type(elementary.es_units(S.h262_chunks(spark, d))).select(F.col("source").alias("s"), F.col("video").alias("other"))
    return own.join(other, F.col("source") == F.col("s")).select("source", "video", "other")


@query(PACKETS + "SELECT n, pid, pts, coalesce(dts, pts) AS dts, dts IS NOT NULL AS explicit FROM packets WHERE pts IS NOT NULL")
def pes_timing_round_trip(spark, d):
    x = S.in_streams(S.packets(spark, d)).where("pts is not null").withColumn("body", F.col("kind").cast("binary"))
    both = transport.pes_header(0xE0, F.length("body"), F.col("pts"), F.col("dts"))
    lone = transport.pes_header(0xE0, F.length("body"), F.col("pts"))
    pes = x.select("source", "pid", F.col("n").alias("pos"), F.concat(F.when(F.col("dts").isNull(), lone).otherwise(both), F.col("body")).alias("data"), F.lit(None).cast("long").alias("pcr"))
    raw = transport.lay_out(transport.pes_to_packets(pes))
    # one transport packet for each PES packet, in order
    got = transport.pes_packets(transport.parse(raw))
    n = places.number(x.select("source", F.col("n").alias("no")), ["source"], F.col("no"), ["no"], "k")
    return got.withColumn("k", F.expr("pos div 188")).join(n, ["source", "k"]).select(F.col("no").alias("n"), S.pid_of(F.col("source"), F.col("pid")).alias("pid"), "pts", "dts", F.col("dts_explicit").alias("explicit"))
