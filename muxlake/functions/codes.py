"""Code tables of the standards, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: H.222.0 stream types
STREAM_TYPES = {
    0x00: "Reserved",
    0x01: "11172-2 video (MPEG-1)",
    0x02: "13818-2 video (MPEG-2)",
    0x03: "11172-3 audio (MPEG-1)",
    0x04: "13818-3 audio (MPEG-2)",
    0x05: "13818-1 private sections",
    0x06: "13818-1 private data in PES packets",
    0x07: "13522 MHEG",
    0x08: "13818-1 Annex A DSM-CC",
    0x09: "H.222.1",
    0x0A: "13818-6 type A",
    0x0B: "13818-6 type B",
    0x0C: "13818-6 type C",
    0x0D: "13818-6 type D",
    0x0E: "13818-1 auxiliary",
    0x0F: "13818-7 Audio with ADTS transport syntax",
    0x10: "14496-2 Visual (MPEG-4 part 2 video)",
    0x11: "14496-3 Audio with LATM transport syntax (14496-3/AMD 1)",
    0x12: "14496-1 SL-packetized or FlexMux stream in PES packets",
    0x13: "14496-1 SL-packetized or FlexMux stream in 14496 sections",
    0x14: "ISO/IEC 13818-6 Synchronized Download Protocol",
    0x15: "Metadata in PES packets",
    0x16: "Metadata in metadata_sections",
    0x17: "Metadata in 13818-6 Data Carousel",
    0x18: "Metadata in 13818-6 Object Carousel",
    0x19: "Metadata in 13818-6 Synchronized Download Protocol",
    0x1A: "13818-11 MPEG-2 IPMP stream",
    0x1B: "H.264/14496-10 video (MPEG-4/AVC)",
    0x24: "HEVC video stream",
    0x25: "HEVC temporal video subset (profile Annex A H.265)",
    0x42: "AVS Video",
    0x7F: "IPMP stream",
    0x81: "ATSC AC-3 audio (user private range)",
}
VIDEO_TYPES = (0x01, 0x02, 0x1B, 0x24, 0x42, 0x10)
DOLBY_TYPES = (0x06, 0x81)
AUDIO_TYPES = (0x03, 0x04, 0x0F, 0x11, *DOLBY_TYPES)
# fixed values: PES and start-code stream ids
STREAM_IDS = {
    0xB9: "PS MPEG_program_end_code",
    0xBA: "PS Pack header start code",
    0xBB: "PS System header start code",
    0xBC: "PS Program stream map",
    0xFF: "PS Program stream directory",
    0xBD: "Private stream 1",
    0xBE: "Padding stream",
    0xBF: "Private stream 2",
    0xF0: "ECM stream",
    0xF1: "EMM stream",
    0xF2: "DSMCC stream",
    0xF3: "13522 stream",
    0xF4: "H.222.1 A stream",
    0xF5: "H.222.1 B stream",
    0xF6: "H.222.1 C stream",
    0xF7: "H.222.1 D stream",
    0xF8: "H.222.1 E stream",
    0xF9: "Ancillary stream",
    0x00: "H.262 Picture",
    0xB2: "H.262 User data",
    0xB3: "H.262 Sequence header",
    0xB4: "H.262 Sequence error",
    0xB5: "H.262 Extension",
    0xB7: "H.262 Sequence end",
    0xB8: "H.262 Group start",
}
# fixed values: H.264 unit types
NAL_TYPES = {
    0: "unspecified",
    1: "slice",
    2: "data partition A",
    3: "data partition B",
    4: "data partition C",
    5: "IDR slice",
    6: "SEI",
    7: "sequence parameter set",
    8: "picture parameter set",
    9: "access unit delimiter",
    10: "end of sequence",
    11: "end of stream",
    12: "filler",
}
# fixed values: DVB component types of stream content 3
DVB_TEXT_COMPONENTS = {
    0x01: "Teletext subtitles",
    0x02: "associated Teletext",
    0x03: "VBI data",
    0x10: "subtitles, any aspect",
    0x11: "subtitles, 4:3",
    0x12: "subtitles, 16:9",
    0x13: "subtitles, 2.21:1",
    0x14: "subtitles, high definition",
    0x20: "subtitles for the hard of hearing, any aspect",
    0x21: "subtitles for the hard of hearing, 4:3",
    0x22: "subtitles for the hard of hearing, 16:9",
    0x23: "subtitles for the hard of hearing, 2.21:1",
    0x24: "subtitles for the hard of hearing, high definition",
}
# fixed values: AC-3 service kinds and channel layouts
BSMOD = {0: "complete main", 1: "music and effects", 2: "visually impaired", 3: "hearing impaired", 4: "dialogue", 5: "commentary", 6: "emergency", 7: "voice over or karaoke"}
ACMOD = {0: "1+1", 1: "1/0", 2: "2/0", 3: "3/0", 4: "2/1", 5: "3/1", 6: "2/2", 7: "3/2"}
# fixed values: descriptor tags of the standards
DESCRIPTORS = {
    2: "Video stream",
    3: "Audio stream",
    4: "Hierarchy",
    6: "Data alignment",
    7: "Target background grid",
    8: "Video window",
    11: "System clock",
    12: "Multiplex buffer use",
    13: "Copyright",
    14: "Maximum bit rate",
    15: "Private data indicator",
    16: "Smoothing buffer",
    17: "STD",
    18: "IBP",
    27: "MPEG-4 video",
    28: "MPEG-4 audio",
    0x41: "Service list",
    0x45: "VBI data",
    0x46: "VBI Teletext",
    0x48: "Service",
    0x4A: "Linkage",
    0x50: "Component",
    0x52: "Stream identifier",
    0x53: "CA identifier",
    0x5F: "Private data specifier",
    0x66: "Data broadcast id",
    0x6F: "Application signalling",
    0x7A: "Enhanced AC-3",
    0x7B: "DTS",
    0x7C: "AAC",
}
# fixed values: AVS frame rates by code
AVS_RATES = {1: 24000 / 1001, 2: 24.0, 3: 25.0, 4: 30000 / 1001, 5: 30.0, 6: 50.0, 7: 60000 / 1001, 8: 60.0}


def _lookup(value: Column, table: dict) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), value.cast("int"))


def stream_type_text(s: Column) -> Column:
    """Name of a stream type."""
    other = F.when((s > 0x1C) & (s < 0x7E), "13818-1 reserved").when((s >= 0x80) & (s <= 0xFF), "User private").otherwise("Unrecognised")
    return F.coalesce(_lookup(s, STREAM_TYPES), other)


def stream_id_text(s: Column) -> Column:
    """Name of a stream id."""
    other = (
        F.when(s.between(0xC0, 0xDF), F.format_string("Audio stream 0x%02X", s.bitwiseAND(0x1F)))
        .when(s.between(0xE0, 0xEF), F.format_string("Video stream 0x%X", s.bitwiseAND(0x0F)))
        .when(s.between(0xFC, 0xFE), "Reserved data stream")
        .otherwise("Unrecognised stream id")
    )
    return F.coalesce(_lookup(s, STREAM_IDS), other)


def is_video_type(s: Column) -> Column:
    """Whether a stream type is video."""
    return s.isin(*VIDEO_TYPES)


def is_audio_type(s: Column) -> Column:
    """Whether a stream type is audio (both customs for Dolby)."""
    return s.isin(*AUDIO_TYPES)


def is_audio_id(s: Column) -> Column:
    """Whether a stream id is an audio stream."""
    return s.between(0xC0, 0xDF)


def is_video_id(s: Column) -> Column:
    """Whether a stream id is a video stream."""
    return s.between(0xE0, 0xEF)


def start_code_text(s: Column) -> Column:
    """Name of an H.262 start code."""
    return F.when(s.between(0x01, 0xAF), F.format_string("H.262 Slice %d", s)).otherwise(stream_id_text(s))


def avs_frame_rate(code: Column) -> Column:
    """Frames a second of an AVS frame-rate code."""
    return F.coalesce(_lookup(code, AVS_RATES), F.lit(25.0))


def nal_type_text(t: Column) -> Column:
    """Name of an H.264 unit type."""
    return F.coalesce(_lookup(t, NAL_TYPES), F.when(t < 24, "reserved").otherwise("unspecified"))


def dvb_component_text(t: Column) -> Column:
    """What a DVB component type says of subtitles and Teletext."""
    other = F.when(t.between(0xB0, 0xFE), "user defined").otherwise("reserved")
    return F.coalesce(_lookup(t, DVB_TEXT_COMPONENTS), other)


def service_text(bsmod: Column, acmod: Column) -> Column:
    """AC-3 service kind and channel layout; kind 7 depends on the layout."""
    kind = F.when(bsmod == 7, F.when(acmod == 1, "voice over").otherwise("karaoke")).otherwise(_lookup(bsmod, BSMOD))
    return F.concat_ws(", ", kind, _lookup(acmod, ACMOD))


def profile_note(profile: Column, baseline: Column, main: Column, extended: Column) -> Column:
    """A remark on an H.264 stream outside the main profile; null if it is within.

    The three flags tell which profiles' constraints the stream says it obeys.
    """
    name = F.when(profile == 66, "baseline").when(profile == 88, "extended").otherwise("unknown")
    obeyed = F.concat_ws(" and ", F.when(baseline, "baseline"), F.when(extended, "extended"))
    tail = F.when(obeyed == "", "").otherwise(F.concat(F.lit(", within the limits of "), obeyed))
    return F.when((profile != 77) & ~main, F.concat(F.lit("declares the "), name, F.format_string(" profile (%d)", profile), tail, F.lit("; parts of it may not be understood")))


def descriptor_name(tag: Column) -> Column:
    """Name of a descriptor tag (null: unknown)."""
    return _lookup(tag, DESCRIPTORS)
