"""Archives: round trips, the contract's rules, and what is refused."""

import hashlib
import random
import struct

import pytest
import zstandard

from gridloom.llm import warc

SCHEMA = "page_id long, url string, html string, id string, frame binary"


def expected(rows):
    out = []
    for i, url, html, *_ in rows:
        raw = (html or "").encode()
        same = [r[0] for r in rows if r[2] == html and r[0] is not None]
        target = max(same) if len(raw) >= 1000 and same else None
        revisit = target is not None and target != i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", target if revisit else None))
    return sorted(out, key=repr)


def pages():
    rng = random.Random(4)
    html = lambda n: "<p>" + "".join(rng.choice("abcdé 😀\r\n") for _ in range(n))
    big, small = html(2000), html(20)
    rows = [(k, f"http://x/{k} é\r\nX-Evil: 1", rng.choice([big, small, html(1500), html(5)]), "c", None) for k in range(80)]
    rows += [(100, None, None, None, None), (101, "", "", None, None), (102, "u", "a" * 1000, None, None), (103, "u", "a" * 1000, None, None), (104, "u", "b" * 999, None, None), (105, "u", "b" * 999, None, None)]
    rows += [(None, "u", big, None, None), (None, "u", html(3000), None, None), (103, "u", "a" * 1000, None, None), (106, "u", html(400_000), None, None), (107, "u", "\r\n\r\nWARC/1.1\r\n", None, None)]
    return rows


def test_round_trip(spark, tmp_path):
    rows = pages()
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(4), str(tmp_path / "a"))
    got = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected(rows)
    texts = {(r[0], hashlib.sha1((r[2] or "").encode()).hexdigest()): (r[2] or "").encode() for r in rows}
    assert all(bytes(r.payload) == texts[r.page_id, r.payload_digest] for r in got if r.record_type == "response")
    assert all(r.payload is None for r in got if r.record_type == "revisit")
    files = list((tmp_path / "a").glob("*.warc.zst"))
    assert files
    for f in files:  # one frame for each record, the dictionary first; any Zstandard reader takes the whole file
        raw = f.read_bytes()
        assert raw[:4] == struct.pack("<I", 0x184D2A5D)
        dictionary, _ = warc.dictionary_of(raw)
        whole = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(raw, read_across_frames=True).read()
        assert whole == b"".join(warc.frames(raw))


def test_archives_are_cut_by_size_whatever_the_shuffle_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    rows = pages()
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(4), str(tmp_path / "a"))
    files = list((tmp_path / "a").glob("*.warc.zst"))
    assert len(files) > 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = warc.read_archives(spark, str(tmp_path / "a"), payloads=False).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected(rows)


def test_payloads_with_very_many_copies(spark, tmp_path, monkeypatch):
    """Beyond HOT copies the response is found by a broadcast; the result is the same."""
    monkeypatch.setattr(warc, "HOT", 3)
    rows = pages()
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(4), str(tmp_path / "a"))
    got = warc.read_archives(spark, str(tmp_path / "a"), payloads=False).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected(rows)


def test_empty_table(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "a"))
    assert warc.read_archives(spark, str(tmp_path / "a")).count() == 0


def archive():
    payload = b"<p>payload</p>" * 5
    rec = warc.record(7, "http://x/", len(payload), hashlib.sha1(payload).hexdigest(), payload)
    raw = b"some dictionary " * 20
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True).compress(rec)
    return rec, warc.DICTIONARY_MAGIC + struct.pack("<I", len(raw)) + raw, frame


def test_plain_and_packed_dictionaries():
    rec, lead, frame = archive()
    assert list(warc.frames(lead + frame + warc.SEPARATOR.encode() + frame)) == [rec, rec]
    packed = zstandard.ZstdCompressor().compress(lead[8:])
    assert list(warc.frames(warc.DICTIONARY_MAGIC + struct.pack("<I", len(packed)) + packed + frame)) == [rec]


def test_broken_archives_are_refused():
    rec, lead, frame = archive()
    for raw in (frame, lead[:20], lead + frame[:-9], lead + b"garbage!!", lead + frame + b"\x28\xb5\x2f\xfd"):
        with pytest.raises(warc.BadArchive):
            list(warc.frames(raw))
    with pytest.raises(zstandard.ZstdError):
        list(warc.frames(lead + frame[:-1] + bytes([frame[-1] ^ 1])))


def test_broken_records_are_refused():
    rec, *_ = archive()
    assert warc.parse(rec)["page_id"] == 7
    for bad in (
        rec.replace(b"WARC/1.1", b"WARC/9.9"),
        rec.replace(b"payload<", b"pay1oad<"),
        rec[:-1],
        rec + b"x",
        rec.replace(b"WARC-Date: ", b"WARC-Dade: "),
        rec.replace(b"WARC-Type: response", b"WARC-Type: revisit"),
        rec.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 1"),
        b"",
        b"WARC/1.1\r\nno colon\r\n\r\n\r\n\r\n",
    ):
        with pytest.raises(warc.BadArchive):
            warc.parse(bad)
