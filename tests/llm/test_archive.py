import gzip
import io
import json
import struct
import zipfile

import pytest
from pyspark.errors import PySparkException

from brindle.llm import archive as A

ROWS = [(1, "http://a.example/x", "<p>one é</p>"), (2, "http://b.example/", ""), (3, None, "<p>three</p>"), (4, "http://c.example/\nbad", None), (None, "http://d.example/", "r\r\n\r\nest"), (1, "http://a.example/x", "<p>one é</p>"), (5, "http://e.example/", "long " * 200_000)]


def _package(members, comment=b"", prefix=b""):
    out = io.BytesIO()
    out.write(prefix)
    with zipfile.ZipFile(out, "a") as z:
        for name, data, how in members:
            z.writestr(name, data, how)
        z.comment = comment
    return out.getvalue()


def _records(n=3):
    raw, index = b"", []
    for i in range(n):
        r = A.record(f"http://x.example/{i}", f"<p>{i}</p>" * (i + 1), f"<urn:page:{i}>")
        index.append(f"com,x)/{i} 2024 " + json.dumps({"offset": str(len(raw)), "length": str(len(r)), "filename": "d.warc.gz"}))
        raw += r
    return raw, "\n".join(index).encode()


def _read(spark, tmp_path, data, name="p.wacz", **how):
    (tmp_path / name).write_bytes(data)
    return A.read_packages(A.find_packages(spark, str(tmp_path)), **how)


def test_pages_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 AS path", "2 AS offset").repartition(2)
    made = A.write_packages(pages, str(tmp_path / "w"))
    assert sum(r.records for r in made.collect()) == len(ROWS)
    found = sorted(map(tuple, A.pages(A.read_packages(made)).collect()), key=str)
    assert found == sorted([(i, u and u.replace("\n", "%0A"), h) for i, u, h in ROWS], key=str)
    assert A.read_packages(A.write_packages(pages.limit(0), str(tmp_path / "e"))).count() == 0


@pytest.mark.parametrize("index_how", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("prefix, comment", [(b"", b""), (b"before" * 50, b"PK\x05 a comment" * 30)])
def test_layouts(spark, tmp_path, index_how, packed, prefix, comment):
    raw, index = _records()
    data = _package([("archive/d.warc.gz", raw, zipfile.ZIP_STORED), ("indexes/i.cdx" + (".gz" if packed else "j"), gzip.compress(index) if packed else index, index_how), ("pages/pages.jsonl", b"{}", zipfile.ZIP_DEFLATED)], comment, prefix)
    assert sorted((r.uri, r.payload.decode(), r.status, r.type) for r in _read(spark, tmp_path, data).collect()) == [(f"http://x.example/{i}", f"<p>{i}</p>" * (i + 1), 200, "response") for i in range(3)]


def test_zip64_directory(spark, tmp_path):
    raw, index = _records()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in (("archive/d.warc.gz", raw), ("indexes/i.cdxj", index)):
            with z.open(name, "w", force_zip64=True) as member:
                member.write(data)
    plain = out.getvalue()
    end = plain.rfind(b"PK\x05\x06")
    count, length, start = struct.unpack("<HII", plain[end + 10 : end + 20])
    # sizes and offsets of the entries moved into the ZIP64 field, and a ZIP64 end before the plain one
    central, at = b"", start
    for _ in range(count):
        head, (n, extra, note) = plain[at : at + 46], struct.unpack("<HHH", plain[at + 28 : at + 34])
        packed, full = struct.unpack("<II", head[20:28])
        header = struct.unpack("<I", head[42:46])[0]
        more = struct.pack("<HHQQQ", 1, 24, full, packed, header)
        central += head[:20] + b"\xff" * 8 + struct.pack("<HHH", n, len(more), 0) + head[34:42] + b"\xff" * 4 + plain[at + 46 : at + 46 + n] + more
        at += 46 + n + extra + note
    big = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, len(central), start)
    mark = struct.pack("<4sIQI", b"PK\x06\x07", 0, start + len(central), 1)
    data = plain[:start] + central + big + mark + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert [m.name for m in A.directory(io.BytesIO(data), len(data))] == ["archive/d.warc.gz", "indexes/i.cdxj"]
    assert _read(spark, tmp_path, data).count() == 3


def test_members_without_an_index_are_read_whole(spark, tmp_path):
    raw, _ = _records()
    plain = b"".join(gzip.decompress(A.record(f"http://y.example/{i}", "h", None)) for i in range(2))
    data = _package([("archive/d.warc.gz", raw, zipfile.ZIP_STORED), ("archive/e.warc", plain, zipfile.ZIP_STORED)])
    assert _read(spark, tmp_path, data).count() == 5


@pytest.mark.parametrize("listed", [[1], [0, 2], [3], [0, 1, 2, 3]])
def test_records_that_no_index_names_are_read(spark, tmp_path, listed):
    raw, index = _records(4)
    lines = b"\n".join(line for i, line in enumerate(index.splitlines()) if i in listed)
    plain = b"".join(gzip.decompress(A.record(f"http://y.example/{i}", "h" * 9, None)) for i in range(3))
    data = _package([("archive/d.warc.gz", raw, zipfile.ZIP_STORED), ("archive/e.warc", plain, zipfile.ZIP_STORED), ("indexes/i.cdxj", lines, zipfile.ZIP_STORED)])
    assert sorted(r.uri for r in _read(spark, tmp_path, data).collect()) == [f"http://x.example/{i}" for i in range(4)] + [f"http://y.example/{i}" for i in range(3)]


def test_members_of_one_name_are_told_apart(spark, tmp_path):
    raw = {f: A.record(f"http://{f}.example/", f"<p>{f}</p>", None) for f in "ab"}
    line = lambda f, name: f"x 2024 " + json.dumps({"offset": 0, "length": len(raw[f]), "filename": name})
    members = [(f"archive/{f}/data.warc.gz", raw[f], zipfile.ZIP_STORED) for f in "ab"]
    good = _package([*members, ("indexes/i.cdxj", "\n".join([line("a", "a/data.warc.gz"), line("b", "archive/b/data.warc.gz")]), zipfile.ZIP_STORED)])
    assert sorted(r.payload.decode() for r in _read(spark, tmp_path, good).collect()) == ["<p>a</p>", "<p>b</p>"]
    (tmp_path / "bad").mkdir()
    with pytest.raises(PySparkException, match="has 2"):
        _read(spark, tmp_path / "bad", _package([*members, ("indexes/i.cdxj", line("a", "data.warc.gz"), zipfile.ZIP_STORED)])).collect()


@pytest.mark.parametrize("chunk", [1, 7, 64, 10_000])
def test_streaming_equals_whole_reading(chunk):
    packed = [A.record(f"http://x.example/{i}", "p" * i * 37, None) for i in range(6)]
    plain = [gzip.decompress(p) for p in packed]
    for raw, sizes in ((b"".join(packed), packed), (b"\r\n".join(plain) + b"\r\n", None), (packed[0] + plain[1] + packed[2], None)):
        found = list(A._all_records(io.BytesIO(b"before" + raw + b"after"), 6, len(raw), chunk))
        assert [A.parse(r)[1] for _, r in found] == [f"http://x.example/{i}" for i in range(len(found))] and len(found) in (3, 6)
        if sizes:
            assert [at for at, _ in found] == [6 + sum(map(len, sizes[:i])) for i in range(6)]
    with pytest.raises(ValueError, match="cut off"):
        list(A._all_records(io.BytesIO(packed[0] + packed[1][:-3]), 0, len(packed[0]) + len(packed[1]) - 3, chunk))


def test_directories_are_read_by_many_tasks(spark, tmp_path):
    raw, index = _records(1)
    data = _package([("archive/d.warc.gz", raw, zipfile.ZIP_STORED), ("indexes/i.cdxj", index, zipfile.ZIP_STORED)])
    for i in range(40):
        (tmp_path / f"p{i}.wacz").write_bytes(data)
    found = A.read_ranges(A.find_packages(spark, str(tmp_path)))
    assert found.count() == 40 and found.rdd.getNumPartitions() == 40


def test_a_bad_record_is_skipped_alone(spark, tmp_path):
    raw, index = _records(3)
    entry = json.loads(index.splitlines()[1][index.splitlines()[1].index(b"{") :])
    at = int(entry["offset"]) + 15
    bad = raw[:at] + bytes(x ^ 255 for x in raw[at : at + 9]) + raw[at + 9 :]
    data = _package([("archive/d.warc.gz", bad, zipfile.ZIP_STORED), ("indexes/i.cdxj", index, zipfile.ZIP_STORED)])
    assert sorted(r.uri for r in _read(spark, tmp_path, data, errors="skip").collect()) == ["http://x.example/0", "http://x.example/2"]
    with pytest.raises(PySparkException):
        _read(spark, tmp_path, data).collect()


def test_ranges_join_neighbours():
    raw, index = _records(40)
    data = _package([("archive/d.warc.gz", raw, zipfile.ZIP_STORED), ("indexes/i.cdxj", index, zipfile.ZIP_STORED)])
    whole = list(A.ranges(io.BytesIO(data), len(data)))
    some = list(A.ranges(io.BytesIO(data), len(data), 1000))
    assert len(whole) == 1 and len(some) > 5 and sum(len(r[2]) for r in some) == 40 and all(r[1] <= 1000 for r in some)


def test_damage(spark, tmp_path):
    raw, index = _records()
    good = _package([("archive/d.warc.gz", raw, zipfile.ZIP_STORED), ("indexes/i.cdxj", index, zipfile.ZIP_STORED)])
    bad = {"deflated": _package([("archive/d.warc.gz", raw, zipfile.ZIP_DEFLATED)]), "cut": good[:-60], "names": _package([("indexes/i.cdxj", index, zipfile.ZIP_STORED)]), "beyond": _package([("archive/d.warc.gz", raw[:-5], zipfile.ZIP_STORED), ("indexes/i.cdxj", index, zipfile.ZIP_STORED)])}
    for name, data in bad.items():
        (tmp_path / name).mkdir()
        with pytest.raises(PySparkException):
            _read(spark, tmp_path / name, data).collect()
    (tmp_path / "ok").mkdir()
    assert _read(spark, tmp_path / "ok", b"", "empty.wacz").count() == 0
    _read(spark, tmp_path / "ok", good)
    assert A.read_packages(A.find_packages(spark, str(tmp_path)), errors="skip").count() == 3
