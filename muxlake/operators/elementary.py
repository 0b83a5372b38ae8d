"""Elementary streams: PTS fields, start-code units, and the video kinds' pictures."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muxlake.functions.bits import BitReader, be, bits, flag, uint, unescape

from .automata import emit
from .packets import islands


def concat_ordered(order: Column, data: Column) -> Column:
    """Aggregate: the binary values joined in the order of ``order``."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), data.alias("d")))), lambda s: F.hex(s["d"]))
    return F.unhex(F.array_join(parts, ""))


def encode_pts(value: Column, guard: int) -> Column:
    """The 5-byte field of a 33-bit time; ``guard`` is 2 for a lone PTS, 3 for a PTS, 1 for a DTS."""
    v = F.pmod(value.cast("long"), F.lit(1 << 33))
    n = F.lit(guard << 36 | 1 << 32 | 1 << 16 | 1) + F.shiftleft(bits(v, 30, 7), 33) + F.shiftleft(bits(v, 15, 0x7FFF), 17) + F.shiftleft(bits(v, 0, 0x7FFF), 1)
    return be(n, 5)


def decode_pts(field: Column, guard: int | None) -> Column:
    """``struct(value, err)`` of a 5-byte field; ``err`` tells a bad guard or marker bit."""
    n = uint(field, 0, 5)
    marks = flag(n, 1) & flag(n, 1 << 16) & flag(n, 1 << 32)
    guarded = F.lit(True) if guard is None else bits(n, 36, 15) == guard
    value = F.shiftleft(bits(n, 33, 7), 30) + F.shiftleft(bits(n, 17, 0x7FFF), 15) + bits(n, 1, 0x7FFF)
    return F.struct(F.when(marks, value).alias("value"), F.when(n.isNull(), "short").when(~marks, "marker").when(~guarded, "guard").alias("err"))


def split_units(chunks: DataFrame, prefix: bytes = b"\x00\x00\x01") -> DataFrame:
    """``(source, start, data)``: units from each ``prefix`` to the next, over chunk boundaries.

    ``chunks`` has (source, infile, data): consecutive pieces of a source at offsets ``infile``. Each
    chunk is searched with the first bytes of those after it; a unit's data is put together from the
    chunks it covers. Bytes before the first prefix belong to no unit.
    """
    tail = len(prefix) - 1
    w = Window.partitionBy("source").orderBy("infile")
    head = F.expr(f"substring(data, 1, {tail})")
    after = F.concat(*[F.coalesce(F.lead(head, k).over(w), F.unhex(F.lit(""))) for k in range(1, tail + 1)])
    x = chunks.where("length(data) > 0").select("source", "infile", "data", after.alias("after"))
    schema = pa.schema([("source", pa.string()), ("at", pa.int64()), ("starts", pa.bool_()), ("data", pa.binary())])

    def run(batches):
        for batch in batches:
            source, at, starts, data = [], [], [], []
            for r in batch.to_pylist():
                own, places = r["data"], []
                both = own + r["after"][:tail]
                i = both.find(prefix)
                while i >= 0:
                    places.append(i)
                    i = both.find(prefix, i + 1)
                cuts = sorted({0, *places, len(own)})
                for a, b in zip(cuts[:-1], cuts[1:]):
                    source.append(r["source"])
                    at.append(r["infile"] + a)
                    starts.append(a in places)
                    data.append(own[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((source, at, starts, data), schema)], schema=schema)

    parts = x.mapInArrow(run, "source string, at long, starts boolean, data binary")
    rows = islands(parts, ["source"], "at", F.col("starts"), "unit").where("unit > 0")
    return rows.groupBy("source", "unit").agg(F.min("at").alias("start"), concat_ordered(F.col("at"), F.col("data")).alias("data")).drop("unit")


def es_units(chunks: DataFrame) -> DataFrame:
    """Start-code units with their code and length."""
    u = split_units(chunks)
    return u.select("source", "start", uint(F.col("data"), 3).cast("int").alias("start_code"), F.length("data").alias("len"), "data")


def video_type(units: DataFrame, limit: int = 500) -> DataFrame:
    """Per source the video kind that the first units do not rule out."""
    w = Window.partitionBy("source").orderBy("start")
    c = F.col("start_code")
    x = units.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= limit)
    ref, kind = bits(c, 5, 3), c.bitwiseAND(31)
    bad_pair = (kind > 12) | ((ref == 0) & kind.isin(5, 7, 8)) | ((ref != 0) & kind.isin(6, 9, 10, 11, 12))
    out = x.groupBy("source").agg(
        F.bool_or(c >= 0xB9).alias("pes"),
        (~F.bool_or((c >= 0x80) | bad_pair)).alias("h264"),
        (~F.bool_or(c.isin(0xB0, 0xB1, 0xB6))).alias("h262"),
        (~F.bool_or(c.isin(0xB4, 0xB8))).alias("avs"),
    )
    one = F.col("h262") != F.col("avs")
    # the other two kinds cannot go on for long without a code that rules H.264 out
    return out.withColumn("video", F.when(F.col("pes"), "probably PES").when(F.col("h264"), "H.264").when(~one, "unknown").when(F.col("h262"), "H.262").otherwise("AVS"))


def pes_video_type(pes: DataFrame, limit: int = 500) -> DataFrame:
    """The vote on the video kind over the elementary data of PES packets (``es_data``) by place."""
    before = F.sum(F.length("es_data").cast("long")).over(Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return video_type(es_units(pes.select("source", F.coalesce(before, F.lit(0).cast("long")).alias("infile"), F.col("es_data").alias("data"))), limit)


def ps_video_type(ps: DataFrame, limit: int = 500) -> DataFrame:
    """The vote over a program stream's video packets."""
    from .transport import decode_pes

    video = ps.where("err is null and stream_id between 224 and 239").select("source", "pos", "data")
    return pes_video_type(decode_pes(video), limit)


# --- H.262 ---------------------------------------------------------------------------------------


def h262_items(units: DataFrame) -> DataFrame:
    """Units with what their H.262 start code says, and picture and AFD fields."""
    c, d = F.col("start_code"), F.col("data")
    user = F.when((c == 0xB2) & (uint(d, 4, 4) == 0x44544731), F.when(flag(uint(d, 8), 0x40), uint(d, 9).bitwiseAND(15)))
    ext = (c == 0xB5) & (bits(uint(d, 4), 4, 15) == 8)
    return units.select(
        "*",
        (c == 0).alias("is_picture"),
        c.between(1, 0xAF).alias("is_slice"),
        (c == 0xB3).alias("is_seq_header"),
        (c == 0xB7).alias("is_seq_end"),
        (c == 0xB8).alias("is_gop"),
        F.when(c == 0, bits(uint(d, 4, 2), 6, 0x3FF)).alias("temporal_reference"),
        F.when(c == 0, F.element_at(F.array(*map(F.lit, "IPBD")), bits(uint(d, 5), 3, 7).cast("int"))).alias("coding"),
        F.when(ext, uint(d, 6).bitwiseAND(3)).alias("structure"),
        F.when(c == 0xB3, bits(uint(d, 7), 4, 15)).alias("aspect"),
        user.alias("afd"),
    )


def h262_pictures(items: DataFrame) -> DataFrame:
    """Pictures, sequence headers and ends: each runs to the first other start after its slices."""
    w = Window.partitionBy("source").orderBy("start")
    head = F.col("is_picture") | F.col("is_seq_header") | F.col("is_seq_end")
    x = islands(items, ["source"], "start", head, "idx").where("idx > 0")
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("start", c)))[c]
    out = x.groupBy("source", "idx").agg(
        F.min("start").alias("start"),
        F.sum("len").alias("size"),
        F.bool_or("is_picture").alias("is_picture"),
        F.bool_or("is_seq_header").alias("is_seq_header"),
        F.count_if("is_slice").alias("slices"),
        first("temporal_reference").alias("temporal_reference"),
        first("coding").alias("kind"),
        first("structure").alias("structure"),
        first("afd").alias("own_afd"),
    )
    held = F.last(F.when(F.col("is_picture"), F.col("own_afd")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("afd", F.when(F.col("is_picture"), held))


def pair_fields(pictures: DataFrame, by: str = "temporal_reference") -> DataFrame:
    """Field pictures joined to frames: a field and the next one of equal ``by``, greedily in order.

    ``structure`` 1 and 2 are fields; a frame, or a field without its second, stands alone. One field
    is held at a time.
    """

    def alone(a):
        idx, size, kind, structure, _ = a
        return (idx, size, kind, 1, structure in (1, 2))

    def step(first, *row):
        if row[3] not in (1, 2):
            return None, [*([alone(first)] if first else []), alone(row)]
        if first is None:
            return row, []
        if first[3] != row[3] and first[4] == row[4]:
            return None, [(first[0], first[1] + row[1], first[2], 2, False)]
        return row, [alone(first)]

    added = T.StructType.fromDDL("idx long, size long, kind string, fields int, unmatched boolean")
    rows = pictures.where("structure is not null").select("source", F.col("idx").cast("long").alias("idx"), F.col("size").cast("long").alias("size"), "kind", "structure", by)
    return emit(rows, ["source"], ["idx"], ["idx", "size", "kind", "structure", by], lambda: None, step, lambda first: [alone(first)] if first else [], added)


def picture_headers(pictures: DataFrame) -> DataFrame:
    """Pictures with the index of the sequence header in force."""
    head = F.when(F.col("is_seq_header"), F.col("start"))
    w = Window.partitionBy("source").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    return pictures.withColumn("seq_start", F.last(head, True).over(w))


# --- H.264 ---------------------------------------------------------------------------------------

NAL = "source string, start long, len int, ref_idc int, unit_type int, err string, sps struct<id: int, profile: int, level: int, log2_frame_num: int, poc_type: int, log2_poc: int, delta_zero: boolean, frame_mbs_only: boolean>, pps struct<id: int, sps_id: int, entropy: boolean, pic_order: boolean, redundant: boolean>, sei struct<type: int, size: int, recovery: int>, pps_id int, rbsp binary"


def nal_units(units: DataFrame) -> DataFrame:
    """Units as NALs with parameter sets decoded; slices keep their first bytes for later."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(NAL))

    def sps(r: BitReader) -> dict:
        profile, _, level = r.read(8), r.read(8), r.read(8)
        out = {"id": r.ue(), "profile": profile, "level": level}
        if profile in (100, 110, 122, 244, 44, 83, 86, 118, 128):
            chroma = r.ue()
            if chroma == 3:
                r.read(1)
            r.ue(), r.ue(), r.read(1)
            if r.read(1):
                for i in range(8 if chroma != 3 else 12):
                    if r.read(1):
                        last = nxt = 8
                        for _ in range(16 if i < 6 else 64):
                            if nxt:
                                nxt = (last + r.se()) % 256
                            last = nxt or last
        out["log2_frame_num"] = r.ue() + 4
        out["poc_type"] = r.ue()
        out["log2_poc"], out["delta_zero"] = 0, False
        if out["poc_type"] == 0:
            out["log2_poc"] = r.ue() + 4
        elif out["poc_type"] == 1:
            out["delta_zero"] = bool(r.read(1))
            r.se(), r.se()
            for _ in range(r.ue()):
                r.se()
        r.ue(), r.read(1), r.ue(), r.ue()
        out["frame_mbs_only"] = bool(r.read(1))
        return out

    def pps(r: BitReader) -> dict:
        out = {"id": r.ue(), "sps_id": r.ue(), "entropy": bool(r.read(1)), "pic_order": bool(r.read(1)), "redundant": False}
        if r.ue() == 0:  # one slice group
            r.ue(), r.ue(), r.read(1), r.read(2), r.se(), r.se(), r.se(), r.read(1), r.read(1)
            out["redundant"] = bool(r.read(1))
        return out

    def sei(data: bytes) -> dict:
        at, values = 0, []
        for _ in range(2):
            v = 0
            while at < len(data) and data[at] == 255:
                v, at = v + 255, at + 1
            values.append(v + data[at])
            at += 1
        return {"type": values[0], "size": values[1], "recovery": BitReader(data[at:]).ue() if values[0] == 6 else None}

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                d = r["data"][3:].rstrip(b"\x00") or b"\x00"
                kind = d[0] & 31
                row = {"source": r["source"], "start": r["start"], "len": r["len"], "ref_idc": d[0] >> 5 & 3, "unit_type": kind, "err": "forbidden bit" if d[0] & 0x80 else None, "sps": None, "pps": None, "sei": None, "pps_id": None, "rbsp": None}
                try:
                    if row["err"] is None and kind in (6, 7, 8):
                        body = unescape(d[1:])
                        row[{6: "sei", 7: "sps", 8: "pps"}[kind]] = sei(body) if kind == 6 else sps(BitReader(body)) if kind == 7 else pps(BitReader(body))
                    elif kind in (1, 5):
                        head = unescape(d[1:64])
                        r2 = BitReader(head)
                        r2.ue(), r2.ue()
                        row["pps_id"], row["rbsp"] = r2.ue(), head
                except (EOFError, IndexError):
                    row["err"] = "short"
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return units.select("source", "start", "len", "data").mapInArrow(run, NAL)


def with_parameter_sets(nals: DataFrame) -> DataFrame:
    """Slices with the parameter sets in force: the last definition of each id before the slice."""
    is_slice = F.col("rbsp").isNotNull()
    # units of neither kind are spread, as they look nothing up
    spread = -1 - F.col("start") % 4096

    def latest(df: DataFrame, column: str, wanted: Column) -> DataFrame:
        key = F.when(is_slice, wanted).when(F.col(column).isNotNull(), F.col(f"{column}.id"))
        w = Window.partitionBy("source", "_key").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
        own = F.when(~is_slice, F.col(column))
        return df.withColumn("_key", F.coalesce(key, spread)).withColumn(column, F.when(is_slice, F.last(own, True).over(w)).otherwise(F.col(column))).drop("_key")

    return latest(latest(nals, "pps", F.col("pps_id")), "sps", F.col("pps.sps_id"))


SLICE = "struct<first_mb: int, slice_type: int, pps_id: int, frame_num: int, field: boolean, bottom: boolean, idr_id: int, poc_lsb: int, delta_poc: int, delta0: int, delta1: int, redundant: int>"


def slice_headers(nals: DataFrame) -> DataFrame:
    """Adds ``slice``: header fields of slices that have their parameter sets."""

    def one(rbsp, kind, sps, pps):
        if rbsp is None or sps is None or pps is None:
            return None
        try:
            r = BitReader(bytes(rbsp))
            out = {"first_mb": r.ue(), "slice_type": r.ue(), "pps_id": r.ue(), "frame_num": r.read(sps["log2_frame_num"]), "field": False, "bottom": False, "idr_id": None, "poc_lsb": None, "delta_poc": None, "delta0": None, "delta1": None, "redundant": 0}
            if not sps["frame_mbs_only"]:
                out["field"] = bool(r.read(1))
                if out["field"]:
                    out["bottom"] = bool(r.read(1))
            if kind == 5:
                out["idr_id"] = r.ue()
            if sps["poc_type"] == 0:
                out["poc_lsb"] = r.read(sps["log2_poc"])
                if pps["pic_order"] and not out["field"]:
                    out["delta_poc"] = r.se()
            elif sps["poc_type"] == 1 and not sps["delta_zero"]:
                out["delta0"] = r.se()
                if pps["pic_order"] and not out["field"]:
                    out["delta1"] = r.se()
            if pps["redundant"]:
                out["redundant"] = r.ue()
            return out
        except EOFError:
            return None

    @F.pandas_udf(SLICE)
    def decode(rbsp: pd.Series, kind: pd.Series, sps: pd.DataFrame, pps: pd.DataFrame) -> pd.DataFrame:
        names = ["first_mb", "slice_type", "pps_id", "frame_num", "field", "bottom", "idr_id", "poc_lsb", "delta_poc", "delta0", "delta1", "redundant"]
        rows = []
        for b, k, s, p in zip(rbsp, kind, sps.to_dict("records"), pps.to_dict("records")):
            got = None if pd.isna(s["id"]) or pd.isna(p["id"]) else one(b, k, {n: None if pd.isna(v) else int(v) for n, v in s.items()}, p)
            rows.append(got or dict.fromkeys(names))
        return pd.DataFrame(rows, columns=names)

    x = with_parameter_sets(nals)
    got = decode("rbsp", "unit_type", "sps", "pps")
    return x.withColumn("slice", got).withColumn("slice", F.when(F.col("slice.frame_num").isNotNull(), F.col("slice")))


def start_reason(last: str = "last", own: str = "slice") -> Column:
    """Why a slice starts a picture (null: it does not), compared with the last slice."""
    a, b = (lambda n: F.col(f"{last}.{n}")), (lambda n: F.col(f"{own}.{n}"))
    differs = lambda n: ~a(n).eqNullSafe(b(n))
    idr = lambda s: F.col("last_type" if s == last else "unit_type") == 5
    return (
        F.when(F.col(last).isNull(), "first slice")
        .when(differs("frame_num"), "frame number")
        .when(differs("pps_id"), "parameter set")
        .when(differs("field"), "field flag")
        .when(differs("bottom"), "bottom flag")
        .when((F.col("ref_idc") != F.col("last_ref")) & ((F.col("ref_idc") == 0) | (F.col("last_ref") == 0)), "reference level")
        .when(differs("poc_lsb") | differs("delta_poc"), "picture order count")
        .when(differs("delta0") | differs("delta1"), "picture order deltas")
        .when(idr(last) != idr(own), "IDR flag")
        .when(idr(own) & differs("idr_id"), "IDR picture id")
    )


def access_units(sliced: DataFrame, keep_redundant: bool = False) -> DataFrame:
    """Access units: pictures with the delimiters, SEI and parameter sets that lead to them.

    A unit of type 6-9 or 14-18 after a slice belongs to the next picture. Broken units and
    redundant slices are left out.
    """
    x = sliced.where("err is null")
    if not keep_redundant:
        x = x.where("slice is null or slice.redundant = 0")
    w = Window.partitionBy("source").orderBy("start")
    is_slice = F.col("slice").isNotNull()
    s = x.where(is_slice).withColumn("last", F.lag("slice").over(w)).withColumn("last_ref", F.lag("ref_idc").over(w)).withColumn("last_type", F.lag("unit_type").over(w))
    s = s.withColumn("reason", start_reason()).select("source", "start", "reason")
    x = x.join(s.withColumnsRenamed({"source": "s2", "start": "start2"}), (F.col("source") == F.col("s2")) & (F.col("start") == F.col("start2")), "left").drop("s2", "start2")
    # a leading unit starts the access unit if the next slice starts a picture and a slice came before it
    lead = F.col("unit_type").isin(6, 7, 8, 9, 14, 15, 16, 17, 18)
    after = F.lag(F.coalesce(~lead, F.lit(True))).over(w)
    starts = (lead & F.coalesce(after, F.lit(True))) | (F.col("reason").isNotNull() & F.coalesce(~F.lag(lead).over(w), F.lit(True)))
    x = islands(x, ["source"], "start", starts, "idx")
    kinds = F.array_sort(F.array_distinct(F.collect_list(F.when(is_slice, F.col("slice.slice_type") % 5))))
    out = x.groupBy("source", "idx").agg(
        F.min("start").alias("start"),
        F.sum("len").alias("size"),
        F.count_if(is_slice).alias("slices"),
        F.min(F.when(is_slice, F.struct("start", "ref_idc", "unit_type", F.col("slice.frame_num").alias("frame_num"), F.col("slice.field").alias("field"), F.col("slice.bottom").alias("bottom")))).alias("primary"),
        kinds.alias("kinds"),
        F.min_by("reason", "start").alias("reason"),
        F.bool_or(F.coalesce(F.col("sei.type") == 6, F.lit(False))).alias("recovery"),
    )
    k = F.col("kinds")
    klass = F.when(F.size(k) == 0, None).when(k == F.array(F.lit(2)), "I").when(k == F.array(F.lit(0)), "P").when(k == F.array(F.lit(1)), "B").otherwise("mixed")
    structure = F.when(~F.col("primary.field"), 3).when(F.col("primary.bottom"), 2).otherwise(1)
    return out.select("source", "idx", "start", "size", "slices", klass.alias("slice_class"), klass.alias("kind"), (F.col("primary.ref_idc") > 0).alias("ref"), (F.col("primary.unit_type") == 5).alias("idr"), F.col("primary.frame_num").alias("frame_num"), F.when(F.col("slices") > 0, structure).alias("structure"), "recovery")


def non_empty(units: DataFrame) -> DataFrame:
    """Access units that have a picture."""
    return units.where("slices > 0")


# --- AVS -----------------------------------------------------------------------------------------


def avs_frames(units: DataFrame) -> DataFrame:
    """AVS frames and sequence headers: a unit B3, B6, B0 or B1 opens one."""
    c, d = F.col("start_code"), F.col("data")
    x = islands(units, ["source"], "start", c.isin(0xB3, 0xB6, 0xB0, 0xB1), "idx").where("idx > 0")
    coding = F.when(c == 0xB3, "I").when(c == 0xB6, F.element_at(F.array(F.lit("P"), F.lit("B")), bits(uint(d, 6), 6, 3).cast("int")))
    x = x.select("*", coding.alias("coding"), F.when(c == 0xB0, bits(uint(d, 10, 2), 6, 15)).alias("rate_code"))
    return x.groupBy("source", "idx").agg(F.min("start").alias("start"), F.sum("len").alias("size"), F.max("coding").alias("kind"), F.bool_or(F.col("start_code") == 0xB0).alias("is_seq_header"), F.max("rate_code").alias("rate_code"))
