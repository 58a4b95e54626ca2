"""Files as other writers make them: unknown sizes, other time scales, block groups, unknown elements."""

import struct

import pytest

from lakesift.llm import media


def unknown(kind, body):
    return kind.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body


def cluster_body(first, n, scale=1, group=False):
    block = media._element(media.SIMPLE_BLOCK, media.lace([bytes([k]) * 10 for k in range(n)], 1, 5, media.FIXED_LACING))
    if group:
        block = media._element(media.BLOCK_GROUP, media._element(media.BLOCK, media.lace([b"g" * 3], 1, -2, media.NO_LACING)) + media._uint(0x9B, 40))
    return media._uint(media.TIMESTAMP, first) + media._element(0xEC, b"void") + block


def file_of(body, scale=None, duration=None):
    info = (media._uint(media.TIMESTAMP_SCALE, scale) if scale else b"") + (media._element(media.DURATION, struct.pack(">f", duration)) if duration else b"")
    return media._HEADER + unknown(media.SEGMENT, media._element(media.INFO, info) + media._TRACKS + body)


def test_unknown_sizes_end_before_a_sibling():
    body = b"".join(unknown(media.CLUSTER, cluster_body(100 * k, 4)) for k in range(3))
    cue = media._element(media.CUES, media._element(media.CUE_POINT, media._uint(media.CUE_TIME, 100) + media._element(media.CUE_TRACK_POSITIONS, media._uint(media.CUE_TRACK, 1) + media._uint(media.CUE_CLUSTER_POSITION, 0))))
    data = file_of(body + cue)
    file = media.parse(data)
    assert len(file.packets) == 12 and [p.cluster for p in file.packets] == [0] * 4 + [1] * 4 + [2] * 4 and len(file.clusters) == 3 and len(file.cues) == 1
    assert all(data[c:c + 4] == media.CLUSTER.to_bytes(4, "big") for c in file.clusters)
    assert [p.timestamp // 1_000_000 for p in file.packets[::4]] == [5, 105, 205]


def test_a_long_file_of_unknown_sizes():
    data = media.write_samples(bytes(576 * 1300))
    known = media.parse(data)
    body = data[len(media._HEADER):]
    kind, at = media._vint(body, 0, True)
    _, at = media._vint(body, at, False)
    parts = [(k, body[a:b]) for k, a, b in media.elements(body, at, len(body))]
    again = media._HEADER + unknown(kind, b"".join(unknown(k, x) if k == media.CLUSTER else media._element(k, x) for k, x in parts))
    found = media.parse(again)
    assert len(found.packets) == 1300 and len(found.clusters) == 3 and found.packets[-1].timestamp == known.packets[-1].timestamp


def test_time_scale():
    file = media.parse(file_of(media._element(media.CLUSTER, cluster_body(1000, 2)), scale=100_000, duration=50.0))
    # ticks of 0.1 ms: 1000 + 5 of them, and 12 ms from frame to frame whatever the scale
    assert [p.timestamp for p in file.packets] == [100_500_000, 112_500_000] and file.duration == 5_000_000


def test_block_groups_and_ids_inside_payloads():
    group = media._element(media.CLUSTER, cluster_body(7, 1, group=True))
    inside = media._element(media.CLUSTER, media._uint(media.TIMESTAMP, 0) + media._element(media.SIMPLE_BLOCK, media.lace([media.CLUSTER.to_bytes(4, "big") * 5], 1, 0, media.NO_LACING)))
    data = file_of(group + inside)
    file = media.parse(data)
    assert [data[p.begin:p.end] for p in file.packets] == [b"ggg", media.CLUSTER.to_bytes(4, "big") * 5] and file.packets[0].timestamp == 5_000_000
    assert [data[c:c + 4] for c in file.clusters] == [media.CLUSTER.to_bytes(4, "big")] * 2


def test_damage():
    for data in (b"", b"\x00" * 20, media._HEADER + b"\x18\x53\x80\x67\x8a", b"RIFF" + bytes(40)):
        if data != media._HEADER:
            with pytest.raises(ValueError):
                media.parse(data)


def test_packets_rebuild_the_payload(spark):
    docs = spark.createDataFrame([(1, "abc" * 3000), (2, None), (None, "é")], "doc_id long, text string")
    stored = {r["doc_id"]: bytes(r["media"]) for r in media.media_column(docs).collect()}
    packets = media.packet_table(media.media_column(docs)).orderBy("packet").collect()
    for doc, text in ((1, "abc" * 3000), (2, ""), (None, "é")):
        own = [p for p in packets if p["doc_id"] == doc]
        assert b"".join(stored[doc][p["byte_from"]:p["byte_to"]] for p in own).rstrip(b"\xff") == text.encode()
        assert [p["packet"] for p in own] == list(range(len(own))) and all(p["track"] == 1 for p in own)
