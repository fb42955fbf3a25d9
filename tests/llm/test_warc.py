import base64
import gzip
import hashlib
import random

import pytest

from driftline.llm import warc

PAGES = [
    (5, "http://a/x y\r\nz", "<p>one</p>"), (3, None, "<p>one</p>"), (9, "http://b", ""),
    (7, "http://c", None), (7, "http://c", None), (None, "http://d", "<p>one</p>"),
    (None, None, "alone"), (8, "http://e", "ä\U0001f600\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n"),
    (11, "http://f", "x" * 3_000_000), (12, "http://f", "\x00\x1f\r\n\r\n"), (12, "http://g", "other"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr(
        "*", "'r' as record_type", "1 as payload_bytes", "'k' as refers_to", "2 as __payload")


def brute(rows):
    least = {}
    for i, _, html in rows:
        if i is not None:
            least[html or ""] = min(least.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        data, first = (html or "").encode(), least.get(html or "")
        repeat = first is not None and i != first
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if repeat else "response", first if repeat else None))
    return sorted(out, key=repr)


def test_pages_come_back(pages):
    got = warc.archive_pages(pages).collect()
    assert sorted(map(tuple, got), key=repr) == brute(PAGES)
    assert warc.archive_pages(pages.where("false")).count() == 0


def test_many_copies(spark):
    rows = [(i if i % 4 else None, "u", "" if i % 3 else f"page {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    assert sorted(map(tuple, warc.archive_pages(df).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("compress", [True, False])
def test_archives_hold_the_payloads(spark, pages, tmp_path, compress):
    folder = f"{tmp_path}/{compress}"
    warc.write_archives(pages, folder, compress=compress, archive_bytes=1000)
    rows = warc.read_archives(spark, folder).collect()
    assert not [r for r in rows if r.gap_reason]
    least = {(h or "") for _, _, h in PAGES}
    assert {bytes(r.payload).decode() for r in rows if r.record_type == "response"} == least
    files = [r.content for r in spark.read.format("binaryFile").load(folder).collect()]
    assert len(files) > 1
    for data in map(bytes, files):
        plain = gzip.decompress(data) if compress else data
        at = 0
        while at < len(plain):
            _, _, at = warc.parse(plain, at)


def archive(n, compress, rng):
    parts = []
    for i in range(n):
        found = warc.page_record(i, "u", bytes(rng.randrange(256) for _ in range(rng.randrange(400))),
                                 None, False, "2020-01-01T00:00:00Z")
        parts.append(gzip.compress(found, mtime=0) if compress else found)
    return parts


def ids(found):
    return [int(r.fields["x-page-id"]) for r in found if isinstance(r, warc.Record)]


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_loses_only_what_was_damaged(compress):
    rng = random.Random(3)
    for _ in range(60):
        parts = archive(12, compress, rng)
        hit = sorted(rng.sample(range(12), rng.randrange(4)))
        for i in hit:
            part, how = bytearray(parts[i]), rng.randrange(4)
            at = rng.randrange(4, len(part) - 12)
            if how == 0:
                part[at:] = b""  # cut off
            elif how == 1:
                part[at:at] = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 99)))
            elif how == 2:
                part[:at] = b""
            else:
                part = bytearray(b"junk" * 9)
            parts[i] = bytes(part)
        data = b"".join(parts)
        found = list(warc.salvage(data))
        got = ids(found)
        assert set(range(12)) - set(hit) <= set(got) and got == sorted(got)
        covered = sorted((x.start, x.end) for x in found)
        assert covered[0][0] == 0 and covered[-1][1] == len(data)
        assert all(a[1] == b[0] for a, b in zip(covered, covered[1:]))
        if hit and compress:  # a plain record has header fields that nothing vouches for
            assert any(isinstance(x, warc.Gap) for x in found)


def test_checks(spark, tmp_path):
    good = warc.page_record(1, "u", b"payload", None, False, "2020-01-01T00:00:00Z")
    assert ids(warc.salvage(good)) == [1]
    for old, new, reason in ((b"payload", b"paylord", "warc-payload-digest differs"),
                             (b"WARC-Date", b"WARC-Dote", "no warc-date"),
                             (b"Content-Type: app", b"Content-Type app", "header line without a name"),
                             (b"WARC/1.1", b"WORC/1.1", "no version line"),
                             (b"Content-Type: application", b": application",
                              "header line without a name")):
        found = list(warc.salvage(good.replace(old, new, 1) + good))
        assert ids(found)[-1:] == [1]
        gaps = [x for x in found if isinstance(x, warc.Gap)]
        assert [g.reason for g in gaps] == [reason] and (gaps[0].start, ids(found)) == (0, [1])
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(gzip.compress(b""))) == []
    assert list(warc.salvage(b"\x1f\x8b\x08")) == [warc.Gap(0, 3, "member is cut off")]
    # one member with a sound and a damaged record
    both = gzip.compress(good.replace(b"payload", b"x", 1) + good)
    found = list(warc.salvage(both))
    assert ids(found) == [1] and isinstance(found[0], warc.Gap)


def test_gaps_are_rows(spark, tmp_path):
    rng = random.Random(5)
    parts = archive(5, True, rng)
    parts[2] = parts[2][:40]
    (tmp_path / "a").write_bytes(b"".join(parts))
    (tmp_path / "b").write_bytes(b"no archive at all")
    (tmp_path / "c").write_bytes(b"")
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(int(r.page_id) for r in rows if r.record_type) == [0, 1, 3, 4]
    gaps = {r.archive[-1]: (r.start, r.end) for r in rows if r.gap_reason}
    assert gaps == {"a": (len(parts[0] + parts[1]), len(parts[0] + parts[1]) + 40), "b": (0, 17)}
