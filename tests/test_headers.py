"""The header tree codec and redaction at any depth."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casewright.operators import headers
from casewright.sources import dicom

DEEP = {
    "00080050": ("SH", "A17"),
    "00080060": ("CS", "RF"),
    "00081115[0].0020000E": ("UI", "1.2.3"),
    "00081115[0].00081199[0].00081155": ("UI", "1.2.4.55"),
    "00081115[0].00081199[1].0040A123": ("PN", "Doe^Ann"),
    "00081115[1].00091001": ("LO", "private"),
    "00091010[0].00100010": ("PN", "Hidden"),
    "00100010": ("PN", "Roe^R"),
    "00081115[0].00081199[1].50001001": ("LO", "curve"),
    "60003000": ("OW", ""),
}
FORMS = [(e, u) for e in (True, False) for u in (True, False)]


@pytest.mark.parametrize(("explicit", "undefined"), FORMS)
def test_three_levels_round_trip_byte_for_byte(explicit, undefined):
    raw = dicom.build(DEEP, 2, 3, bytes(range(6)), explicit, undefined)
    tags, rows, cols, pixels = dicom.parse(raw)
    assert (rows, cols, pixels) == (2, 3, bytes(range(6)))
    for path, (kind, text) in DEEP.items():
        if explicit or kind != "LO" and path != "60003000":  # kinds that the implicit form does not spell
            assert tags[path] == (kind, None if kind == "OW" else text)
        assert path in tags
    assert tags["00081115"] == ("SQ", "2") and tags["00081115[0].00081199"] == ("SQ", "2")
    assert dicom.rewrite_bytes(raw, tags) == raw


@pytest.mark.parametrize(("explicit", "undefined"), FORMS)
def test_redaction_inside_sequences(spark, explicit, undefined):
    raw = dicom.build(DEEP, 1, 1, b"\7", explicit, undefined)
    df = spark.createDataFrame([(raw,)], "content binary").select("content", dicom.decode(F.col("content")).alias("h"))
    done = df.select(dicom.rewrite(F.col("content"), headers.redact(F.col("h.tags"))).alias("content"))
    out = bytes(done.first().content)
    tags, *_, pixels = dicom.parse(out)
    assert tags["00100010"] == tags["00081115[0].00081199[1].0040A123"] == ("PN", headers.REDACTED) and pixels == b"\7\0"
    assert tags["00080050"][1] == headers.REDACTED and tags["00081115[0].00081199[0].00081155"] == ("UI", "1.2.4.55")
    assert not any(x in out for x in (b"Doe", b"Roe", b"Hidden", b"private", b"curve")) and "60003000" not in tags
    assert tags["00081115"] == ("SQ", "2") and len([p for p in tags if p.startswith("00081115[1].")]) == 0
    uids = df.select(headers.uid_values(F.col("h.tags")).alias("u")).first().u
    assert uids["00081115[0].0020000E"] == "1_2_3"


def test_unreadable_files_say_so(spark):
    whole = dicom.build(DEEP, 2, 2, b"abcd")
    deep = {"[0].".join(["00081199"] * 70) + "[0].00100010": ("PN", "x")}
    bad = [whole[:-3], whole[:300], b"short", b"", None, whole[:132] + b"\x08\0\x05\0??\1\0x", dicom.build(deep, 1, 1, b"a")]
    got = spark.createDataFrame([(b,) for b in [whole, *bad]], "content binary").select(dicom.decode(F.col("content")).alias("h")).collect()
    assert got[0].h.error is None and got[0].h.tags
    assert all(r.h.error and r.h.tags is None and r.h.pixels is None for r in got[1:])


def test_encapsulated_pixels_and_unknown_sequences_are_kept():
    fragments = b"".join(struct.pack("<HHI", 0xFFFE, 0xE000, len(x)) + x for x in (b"", b"\xff\xd8jpeg")) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    inner = struct.pack("<HHI", 0x0010, 0x0010, 4) + b"Doe "
    unknown = struct.pack("<HH2sHI", 0x0040, 0x9999, b"UN", 0, 0xFFFFFFFF) + struct.pack("<HHI", 0xFFFE, 0xE000, len(inner)) + inner + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    raw = b"\0" * 128 + b"DICM" + unknown + struct.pack("<HH2sHI", 0x7FE0, 0x0010, b"OB", 0, 0xFFFFFFFF) + fragments
    tags, _, _, pixels = dicom.parse(raw)
    assert tags["00409999[0].00100010"] == ("PN", "Doe") and pixels is None
    assert dicom.rewrite_bytes(raw, tags) == raw
    assert b"Doe" not in dicom.rewrite_bytes(raw, tags | {"00409999[0].00100010": ("PN", "X")})


_TAG = st.sampled_from(["00080060", "00100010", "00204000", "00081199", "0040A730"])
_LEAF = st.tuples(st.sampled_from(["LO", "PN", "UT"]), st.text("aB é^", max_size=9).map(str.strip))


@given(st.dictionaries(st.lists(_TAG, min_size=1, max_size=4).map(tuple), _LEAF, max_size=8), st.booleans())
@settings(max_examples=60, deadline=None)
def test_any_tree_round_trips(leaves, undefined):
    sequences = {p[:i] for p in leaves for i in range(1, len(p))}
    tags = {"[0].".join(p): v for p, v in leaves.items() if p not in sequences}
    raw = dicom.build(tags, 1, 2, b"ab", undefined=undefined)
    found, rows, cols, _ = dicom.parse(raw)
    assert {k: v for k, v in found.items() if k in tags} == tags and (rows, cols) == (1, 2)
    assert dicom.rewrite_bytes(raw, found) == raw
