import base64
import glob
import gzip
import hashlib

from lodestitch.llm import warc


def brute(rows, min_bytes=0):
    payload = lambda h: (h or "").encode()
    out = []
    for p, _, h in rows:
        data = payload(h)
        same = [q for q, _, x in rows if payload(x) == data and q is not None]
        top = max(same, default=None) if len(data) >= min_bytes else None
        revisit = top is not None and len([1 for _, _, x in rows if payload(x) == data]) > 1 and (p is None or p < top)
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/ x\r\ny", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n\r\n\r\n"),
    (6, "http://f", "x" * 300_000), (7, "http://g", "<p>é</p>"), (None, "http://h", "<p>é</p>"), (8, "http://i", "single\r\n\r\n"), (8, "http://i", "single\r\n\r\n"),
]


def run(spark, tmp_path, rows, **more):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = str(tmp_path / "archive")
    warc.write_archive(df, path, **more)
    return warc.captured_pages(warc.assemble(warc.read_records(spark, path)))


def test_round_trip(spark, tmp_path):
    got = run(spark, tmp_path, ROWS).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == brute(ROWS)
    assert all(r.n_requests == 1 for r in got)


def test_least_payload(spark, tmp_path):
    got = run(spark, tmp_path, ROWS, min_bytes=1).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == brute(ROWS, 1)


def test_payloads_and_files(spark, tmp_path):
    df = spark.createDataFrame(ROWS[:6], "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    warc.write_archive(df, path)
    captures = warc.assemble(warc.read_records(spark, path)).collect()
    html = {c.metadata.fields["page-id"]: c.response.payload for c in captures}
    assert html["5"] == ROWS[4][2].encode() and html["6"] == b"x" * 300_000 and html["1"] is None
    data = b"".join(gzip.open(f).read() for f in glob.glob(f"{path}/*.gz"))
    assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n") and data.count(b"WARC-Type: metadata") == 6


def test_revisits_name_their_response(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    warc.write_archive(df, path)
    records = warc.read_records(spark, path).collect()
    ids = [r.record_id for r in records]
    assert len(set(ids)) == len(ids) == 3 * len(ROWS)
    responses = {r.record_id: r for r in records if r.type == "response"}
    revisits = [r for r in records if r.type == "revisit"]
    assert revisits and all(responses[r.refers_to].payload_digest == r.payload_digest for r in revisits)


def records_of(spark, rows):
    return spark.createDataFrame([(i, kind, to, None, None, None, None, None, None) for i, kind, to in rows], warc._RECORD)


def test_chains_and_several_targets(spark):
    rows = [("<r>", "response", []), ("<q>", "request", ["<r>"]), ("<m>", "metadata", ["<q>"]), ("<m2>", "metadata", ["<m>"]), ("<m3>", "metadata", ["<gone>", "<r>"])]
    rows += [("<r2>", "response", ["<q2>"]), ("<q2>", "request", []), ("<a>", "metadata", ["<b>"]), ("<b>", "metadata", ["<a>"]), (None, "metadata", []), (None, "metadata", []), (None, "request", ["<r>"])]
    got = {r.capture_id: r for r in warc.assemble(records_of(spark, rows).repartition(3)).collect()}
    assert got["<r>"].n_requests == 2 and got["<r>"].n_metadata == 3 and got["<r>"].metadata.record_id == "<m2>"
    assert got["<r2>"].request.record_id == "<q2>"
    assert len(got) == 6 and sum(r.response is None and r.n_metadata == 1 for r in got.values()) == 4


def test_repeated_headers_are_all_read():
    record = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <m>\r\nWARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <b>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    assert [warc._row(*r)[2] for r in warc.parse_archive(record)] == [["<a>", "<b>"]]


def test_orphans_and_empty(spark, tmp_path):
    assert run(spark, tmp_path, []).count() == 0
    rows = [("<q>", "request", ["<gone>"]), ("<r>", "response", None), ("<m2>", "metadata", ["<r>"]), ("<m1>", "metadata", ["<r>"])]
    records = records_of(spark, rows)
    got = {r.capture_id: r for r in warc.assemble(records).collect()}
    assert got["<gone>"].response is None and got["<r>"].metadata.record_id == "<m1>" and got["<r>"].n_metadata == 2
