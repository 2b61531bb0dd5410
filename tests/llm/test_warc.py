"""WARC archives: round trips, and what is left of damaged ones."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random

import pytest

from tessella.llm import warc


def sha(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_rows() -> list[tuple]:
    nested = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(i, f"https://x.org/{i}", f"<p>{i % 7} é\U0001f600</p>") for i in range(3, 40)]
    rows += [(50, None, None), (51, "", ""), (52, "https://a b/\r\nInjected: 1\x00\t", nested), (53, "u", "x" * 300_000), (54, "u", "x" * 300_000), (3, "https://x.org/3", "<p>3 é\U0001f600</p>")]
    return rows + [(-5, "u", "neg"), (None, "u", "neg"), (None, "u", "no id at all"), (60, "u", "\r\n\r\n"), (61, "u", "\x1f\u008b\x08 and WARC/1.0\r\n")]


def frame(spark, rows):
    return spark.createDataFrame([(html, i, url, "y", 5) for i, url, html in rows], "html string, page_id long, url string, HTML string, payload int")


def expected(rows, least=0):
    first: dict = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if i is not None and len(data) >= least:
            first[data] = min(first.get(data, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        to = first.get(data)
        refers = to if to is not None and to != i else None
        out.append((i, len(data), sha(data), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize(("compress", "least"), [(False, 0), (True, 0), (False, 12)])
def test_round_trip(spark, compress, least):
    rows = page_rows()
    found = warc.round_trip(frame(spark, rows).repartition(3), compress, least)
    assert sorted(map(tuple, found.collect()), key=str) == expected(rows, least)
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("compress", [False, True])
def test_nothing_to_write(spark, compress):
    assert warc.round_trip(frame(spark, []).limit(0), compress).collect() == []


def archive(spark, folder, compress) -> bytes:
    """One archive of 30 pages."""
    path = f"file://{folder}/{compress}"
    warc.write(frame(spark, [(i, f"https://x/{i}", f"page {i} " * (i + 1)) for i in range(30)]).coalesce(1), path, compress)
    (file,) = (folder / str(compress)).glob("part-*")
    return file.read_bytes()


def read(data: bytes) -> tuple[list[int], list[dict]]:
    """Pages and gaps; together they must cover all bytes once."""
    found = list(warc.salvage(io.BytesIO(data)))
    at = 0
    for x in found:
        assert x["offset"] - at in (0, 20)  # an empty member closes a record
        at = x["offset"] + x["length"]
    assert len(data) - at in (0, 20)
    return [int(x["fields"]["warc-record-id"].split(":")[3]) for x in found if not x["reason"]], [x for x in found if x["reason"]]


@pytest.mark.parametrize("compress", [False, True])
def test_salvage(spark, tmp_path, compress):
    data = archive(spark, tmp_path, compress)
    every, none = read(data)
    assert sorted(every) == list(range(30)) and not none
    if compress:  # every record is a member of its own
        assert gzip.decompress(data).count(b"WARC-Record-ID") == 30 == sum(1 for x in warc.salvage(io.BytesIO(data)))
    spots = [(x["offset"], x["length"]) for x in warc.salvage(io.BytesIO(data))]
    pages = every
    # A byte of a block is changed: that record alone is lost.
    for k in (0, 7, 29):
        at, size = spots[k]
        bad = bytearray(data)
        bad[at + size - 8] ^= 0x15
        found, gaps = read(bytes(bad))
        assert found == pages[:k] + pages[k + 1 :] and [(g["offset"], g["length"]) for g in gaps] == [(at, size)]
    # Cut off, preceded by something else, a piece in the middle gone, and two neighbours damaged.
    at, size = spots[29]
    assert read(data[: at + size - 9])[0] == pages[:-1]
    found, (gap,) = read(b"\x1f\x8b\x08noise WARC/1.1\r\n" + data)
    assert found == pages and gap["length"] == 19 and gap["offset"] == 0
    at, size = spots[12]
    assert read(data[: at + 20] + data[at + size - 5 :])[0] == pages[:12] + pages[13:]
    bad = bytearray(data)
    for k in (4, 5):
        bad[spots[k][0] + 1] = 0
    found, gaps = read(bytes(bad))
    assert found == pages[:4] + pages[6:] and gaps[0]["offset"] == spots[4][0] and sum(g["length"] for g in gaps) == spots[4][1] + spots[5][1]


def test_random_damage(spark, tmp_path):
    """Whatever is flipped, no other record is lost and no payload that fails its digest comes through."""
    rng = random.Random(3)
    for compress in (False, True):
        data = archive(spark, tmp_path, compress)
        spots = [(x["offset"], x["offset"] + x["length"], x["fields"]["warc-record-id"]) for x in warc.salvage(io.BytesIO(data))]
        for _ in range(60):
            bad, at = bytearray(data), rng.randrange(len(data))
            bad[at] ^= 1 << rng.randrange(8)
            found = [x for x in warc.salvage(io.BytesIO(bytes(bad))) if not x["reason"]]
            kept = {x["fields"].get("warc-record-id") for x in found}
            assert {i for a, b, i in spots if not a <= at < b} <= kept
            assert all(sha(x["payload"]) == x["fields"]["warc-payload-digest"][5:] for x in found if "warc-payload-digest" in x["fields"])


def test_read_files(spark, tmp_path):
    """Files of both sizes, a damaged one, an empty one, and the quarantine log."""
    data = archive(spark, tmp_path, False)
    more = archive(spark, tmp_path, True)
    folder = tmp_path / "mixed"
    folder.mkdir()
    bad = bytearray(more)
    bad[len(bad) // 2] ^= 1
    for name, content in {"a.warc": data, "b.warc.gz": more, "c.warc.gz": bytes(bad), "d.warc": b"", "e.warc": b"not an archive"}.items():
        (folder / name).write_bytes(content)
    for small in (2**25, 100, 0):
        found = warc.read(spark, f"file://{folder}", small=small)
        assert found.where("reason is null").count() == 89
        log = sorted((r["path"][-8:], r["offset"], r["length"]) for r in warc.gaps(found).collect())
        assert [x[0] for x in log] == [".warc.gz", "d/e.warc"] and log[1][1:] == (0, 14)
    row = found.where("path like '%a.warc' and reason is null and record_id like '%page:7:%'").first()
    assert bytes(row["payload"]) == b"page 7 " * 8 and row["target_uri"] == "https://x/7" and row["headers"]["warc-type"] == "response"


def test_foreign_records():
    """Version 1.0, other record types, no digests, headers in any case."""
    body = b"software: x\r\n"
    data = b"WARC/1.0\r\nwarc-type: warcinfo\r\nCONTENT-LENGTH: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    (info, again) = list(warc.salvage(io.BytesIO(data * 2)))
    assert info["payload"] == body and info["fields"]["warc-type"] == "warcinfo" and again["offset"] == len(data)
    (one, two) = list(warc.salvage(io.BytesIO(gzip.compress(data * 2))))
    assert one["payload"] == two["payload"] == body


def test_windows():
    data = bytes(range(256)) * 5000 + b"WARC/1.1\r\n" + b"x" * 100
    window = warc.Window(io.BytesIO(data))
    assert window.next_mark(0) == 1_280_000 and window.find(b"\r\nxx", 0, 2**30) == 1_280_008 and window.find(b"nothing", 0, 2**30) == -1
    assert window.find(b"WARC", 0, 1000) == -1 and window.read(5, 3) == b"\x05\x06\x07"
