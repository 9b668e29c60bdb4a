import base64
import hashlib
import struct
from pathlib import Path

import zstandard

from stockwarden.llm import warc

SCHEMA = "page_id long, url string, html string, digest int, payload int, row int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)


def slow(rows):
    first, out = {}, []
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    for page, _, html in rows:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        other = first.get(html or "")
        again = other is not None and other != page
        out.append((page, len(body), digest, "revisit" if again else "response", other if again else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/x y\r\nWARC-Type: evilä", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://b", None), (4, "http://c", ""), (5, "http://d", "ä" * 70_000), (5, "http://d", "ä" * 70_000),
    (9, "http://e", "x\r\n\r\ny"), (8, "http://e", "x\r\n\r\ny"), (None, "http://f", "<p>one</p>"), (None, "http://g", "alone"), (0, "", " "),
]


def test_round_trip_of_odd_pages(spark):
    got = warc.archived(pages(spark, ROWS)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == slow(ROWS)
    assert warc.archived(pages(spark, [])).count() == 0


def test_archives_begin_with_their_dictionary_and_each_record_stands_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 20_000)
    rows = [(k, f"http://h/{k}", "".join(f"<p>paragraph {k * 31 % 97 + n} of page {n * k}</p>" for n in range(40 + k % 60))) for k in range(400)]
    folder = f"file://{tmp_path}/w"
    written = warc.write_archives(pages(spark, rows), folder).collect()
    files = sorted(Path(tmp_path, "w").glob("*.warc.zst"))
    assert sorted(r.archive for r in written) == [f.name for f in files] and len(files) > 1 and sum(r.records for r in written) == 400
    assert not list(Path(tmp_path, "w").glob("_attempt*"))
    raw = files[0].read_bytes()
    magic, size = struct.unpack_from("<II", raw)
    assert magic == 0x184D2A5D and size > 1000
    dictionary = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
    assert dictionary.dict_id() != 0
    one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(raw[8 + size :])
    assert one.startswith(b"WARC/1.1\r\n") and warc.parse(one)[4] == "response"
    plain = sum(len(zstandard.compress(warc.record(k, u, h.encode(), "", None, ""), 3)) for k, u, h in rows)
    assert sum(f.stat().st_size - 8 - size for f in files) < 0.7 * plain
    back = warc.read_archives(spark, folder).collect()
    assert {(r.page_id, r.url, bytes(r.payload).decode()) for r in back} == set(rows)


def test_small_payloads_may_stay_responses(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    warc.write_archives(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long one"), (4, "u", "long one")]), folder, least=5)
    assert {r.page_id: r.record_type for r in warc.read_archives(spark, folder).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_a_changed_payload_is_noticed():
    data = warc.record(1, "u", b"payload", warc.digest_of(b"payload"), None, "")
    assert warc.parse(data)[0] == 1
    try:
        warc.parse(data.replace(b"payload\r\n", b"pAyload\r\n"))
    except ValueError:
        return
    raise AssertionError


def test_files_of_a_lost_attempt_are_not_read(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://x/{k}", f"<p>page {k % 7}</p>") for k in range(40)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    warc.write_archives(pages, folder)
    written = sorted(Path(tmp_path, "w").glob("*.warc.zst"))
    Path(tmp_path, "w", "part-000000-0000-of-another-attempt.warc.zst").write_bytes(written[0].read_bytes())
    Path(tmp_path, "w", "part-000001-0000-cut-short.warc.zst").write_bytes(written[0].read_bytes()[:100])
    assert sorted(r.page_id for r in warc.read_archives(spark, folder).collect()) == list(range(40))
    assert warc.manifest(spark, folder).count() == len(written)


def test_a_path_without_scheme_is_of_the_default_file_system(spark):
    assert warc.qualified(spark, "/tmp/x") == "file:///tmp/x" and warc.qualified(spark, "file:///tmp/x") == "file:///tmp/x"
