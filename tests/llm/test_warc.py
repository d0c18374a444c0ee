"""Round trips, pushed filters and skipped payloads."""

import gzip
import io
import struct
import zlib

import pytest

from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, IsNull, Not

from mosaica.llm.warc import Malformed, Records, http, member, pages_to_warc, parse_headers, passes, register, responses  # noqa: F401


def record(kind, block, extra=(), uri="http://a/"):
    return member([("WARC-Type", kind), ("WARC-Target-URI", uri), *extra], block)


def plain(kind, block):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://x/é", "<p>Grüße\r\n\r\nWARC/1.0\r\n</p>"), (1, "http://x/é", "<p>Grüße\r\n\r\nWARC/1.0\r\n</p>"), (None, "http://y", ""), (3, None, None), (4, "http://z", "long " * 400_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    pages_to_warc(pages, path)
    got = sorted(((r.page_id, r.url, r.html) for r in responses(spark, path).collect()), key=str)
    assert got == sorted(((i, u, h or "") for i, u, h in rows), key=str)
    every = spark.read.format("warc").load(path)
    assert every.where("record_type = 'request'").count() == 5 and every.where("record_type <> 'warcinfo' and content_length > 1000000").count() == 1
    assert every.where("target_uri is null and record_type = 'response'").select("http_status").first()[0] == 200


def test_empty(spark, tmp_path):
    pages_to_warc(spark.createDataFrame([], "page_id long, url string, html string, block int"), f"file://{tmp_path}/w")
    assert responses(spark, f"file://{tmp_path}/w").collect() == []


def test_standard_files(spark, tmp_path):
    """Uncompressed files, and gzip members as other tools write them."""
    blocks = [b"first", b"", b"x" * 200_000, b"WARC/1.0\r\n\r\n"]
    (tmp_path / "a.warc").write_bytes(b"".join(plain("response", b) for b in blocks))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(plain("resource", b)) for b in blocks))
    (tmp_path / "c.txt").write_bytes(b"no warc")
    register(spark)
    rows = spark.read.format("warc").load(f"file://{tmp_path}").collect()
    for kind in ("response", "resource"):
        assert sorted(bytes(r.block) for r in rows if r.record_type == kind) == sorted(blocks)
    one = spark.read.format("warc").option("partitionBytes", "1").load(f"file://{tmp_path}")
    assert one.rdd.getNumPartitions() == 2 and one.where("record_type in ('resource', 'x')").count() == 4


def test_several_records_in_one_member(spark, tmp_path):
    """A file that was compressed as a whole, beside members that carry a length and hold several records."""
    blocks = [b"first", b"", bytes(range(256)) * 2000, b"WARC/1.0\r\n\r\n", b"\r\n\r\n", *(b"%d" % k * 99 for k in range(300))]
    kinds = ["response" if k % 3 else "request" for k in range(len(blocks))]
    every = b"".join(map(plain, kinds, blocks))
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(every))
    body = zlib.compress(every, wbits=-15)
    sl = struct.pack("<H2sHII", 12, b"sl", 8, 24 + len(body) + 8, len(every))
    tail = struct.pack("<II", zlib.crc32(every), len(every))
    (tmp_path / "b.warc.gz").write_bytes((b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + sl + body + tail) * 2 + record("response", b"last"))
    register(spark)
    read = spark.read.format("warc").load(f"file://{tmp_path}")
    want = sorted([*zip(kinds, blocks)] * 3 + [("response", b"last")])
    assert sorted((r.record_type, bytes(r.block)) for r in read.collect()) == want
    assert sorted(bytes(r.block) for r in read.where("record_type = 'request'").collect()) == [b for k, b in want if k == "request"]
    assert read.select("record_type").where("content_length > 0").count() == sum(b != b"" for _, b in want)


def test_no_record_after_a_record(tmp_path):
    for rest in (b"junk\r\n\r\n", b"junk", plain("response", b"x" * 99)[:-40], b"WARC/1.0\r\nContent-"):
        data = gzip.compress(plain("response", b"x") + rest)
        for want in (True, False):
            with pytest.raises(ValueError):
                it = iter(Records(io.BytesIO(data), True, len(data)))
                next(it)
                it.send(want)
                for _ in it:
                    pass


def test_filters_are_pushed(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(plain("response", b"z"))
    register(spark)
    plan = spark.read.format("warc").load(f"file://{tmp_path}").where("record_type = 'response' and content_length < 5")._jdf.queryExecution().executedPlan().toString()
    assert "record_type#" in plan and "Filter" not in plan.split("BatchScan")[0]


def test_unwanted_payloads_are_not_inflated(tmp_path):
    big = bytes(range(256)) * 20_000
    data = record("request", big) + record("response", b"small") + record("request", big)
    (tmp_path / "a.warc.gz").write_bytes(data)
    with (tmp_path / "a.warc.gz").open("rb") as f:
        r = Records(f, True, len(data))
        it, answer, got = iter(r), None, []
        while True:
            try:
                h = it.send(answer)
            except StopIteration:
                break
            answer = h["warc-type"] == "response"
            if answer:
                got.append(it.send(True))
                answer = None
    assert got == [b"small"] and r.inflated < 3 * 4096 + 100
    assert gzip.decompress(data).count(b"WARC/1.1") == 3  # and any gzip reader can read it


def test_cut_off(tmp_path):
    for name, data in (("a.warc.gz", record("response", b"x" * 9999)[:-40]), ("a.warc", plain("response", b"x" * 999)[:-40])):
        (tmp_path / name).write_bytes(data)
        with (tmp_path / name).open("rb") as f, pytest.raises((ValueError, zlib.error)):
            it = iter(Records(f, name.endswith("gz"), len(data)))
            next(it)
            it.send(True)
            next(it)


def test_http_bodies():
    head = b"HTTP/1.1 404 Not Found\r\nContent-Encoding: gzip\r\n\r\n"
    assert http(head + gzip.compress(b"body"))[::2] == (404, b"body")
    assert http(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n2\r\nde\r\n0\r\n\r\n")[2] == b"abcde"
    assert http(b"no http") == (None, None, b"no http")


def test_filters_follow_sql(spark, tmp_path):
    """Every pushed filter, with and without nulls, keeps what Spark keeps."""
    kinds = ["a", "b", None, "resource"]
    (tmp_path / "a.warc").write_bytes(b"".join((f"WARC-Type: {k}\r\n" if k else "").join(("WARC/1.0\r\n", "Content-Length: 1\r\n\r\nx\r\n\r\n")).encode() for k in kinds))
    register(spark)
    read = spark.read.format("warc").load(f"file://{tmp_path}")
    held = spark.createDataFrame([(k, 1) for k in kinds], "record_type string, content_length long")
    for where in ("record_type in ('a', null)", "record_type not in ('a', null)", "record_type not in ('a', 'c')", "not (record_type is not null)", "record_type is null", "record_type <> 'a'", "not (record_type > 'a')", "not (record_type like 're%')", "content_length > 0", "not (record_type <=> 'a')"):
        assert sorted(str(r[0]) for r in read.where(where).select("record_type").collect()) == sorted(str(r[0]) for r in held.where(where).select("record_type").collect()), where
    at = ("record_type",)
    assert passes(Not(In(at, ("a", None))), {"record_type": "b"}) is None and passes(In(at, ("a", None)), {"record_type": "a"}) is True
    assert passes(Not(IsNotNull(at)), {"record_type": None}) is True and passes(Not(EqualTo(at, "a")), {"record_type": None}) is None
    assert passes(IsNull(at), {"record_type": "b"}) is False and passes(GreaterThan(at, None), {"record_type": "b"}) is None


def lf(kind, block):
    return f"WARC/1.0\nWARC-Type: {kind}\nContent-Length: {len(block)}\n\n".encode() + block + b"\n\n"


BAD = [
    b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\nxyz\r\n\r\n",
    b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: -3\r\n\r\nxyz\r\n\r\n",
    b"WARC/1.0\r\nWARC-Type: response\r\n\r\nxyz\r\n\r\n",
    b"HTTP/1.1 200 OK\r\n\r\nxyz\r\n\r\n",
    b"junk\r\n",
]


def read_all(data, gz, permissive, want=True):
    got, it, answer = [], iter(Records(io.BytesIO(data), gz, len(data), permissive)), None
    while True:
        try:
            x = it.send(answer)
        except StopIteration:
            return got
        answer = None
        if not isinstance(x, Malformed) and want:
            x = it.send(True)
        got.append(x)


def test_lenient_lines():
    data = b"\r\n\n" + lf("response", b"one") + b"\r\n\r\n\n" + plain("resource", b"two") + b"\n" + lf("response", b"") + b"\r\n"
    for gz in (False, True):
        assert read_all(gzip.compress(data) if gz else data, gz, False) == [b"one", b"two", b""]
        assert [x["warc-type"] for x in read_all(gzip.compress(data) if gz else data, gz, False, want=False)] == ["response", "resource", "response"]


@pytest.mark.parametrize("bad", BAD)
def test_malformed_records(bad):
    """Before, between and after good records; uncompressed, each a member, and all in one member."""
    good = [plain("response", b"one"), lf("response", b"two" * 9000)]
    for order in ([bad, *good], [good[0], bad, good[1]], [*good, bad], [bad, good[0], bad, good[1], bad]):
        n = order.count(bad)
        for gz, data in ((False, b"".join(order)), (True, b"".join(map(gzip.compress, order))), (True, gzip.compress(b"".join(order)))):
            got = read_all(data, gz, True)
            assert [x for x in got if not isinstance(x, Malformed)] == [b"one", b"two" * 9000]
            assert sum(isinstance(x, Malformed) for x in got) == n
            assert [x["content-length"] for x in read_all(data, gz, True, want=False) if not isinstance(x, Malformed)] == ["3", "27000"]
            with pytest.raises(ValueError):
                read_all(data, gz, False)


def test_broken_members():
    good = gzip.compress(plain("response", b"one")), gzip.compress(plain("response", b"two"))
    broken = bytearray(gzip.compress(plain("response", bytes(range(256)) * 9)))
    broken[len(broken) // 2] ^= 255
    for bad in (bytes(broken), b"no gzip at all", good[0][:-9]):
        got = read_all(good[0] + bad + good[1], True, True)
        assert [x for x in got if x in (b"one", b"two")][0] == b"one" and got[-1] == b"two" and any(isinstance(x, Malformed) for x in got)
    cut = read_all(good[0] + good[1][:-20], True, True)
    assert cut[0] == b"one" and isinstance(cut[-1], Malformed)


def test_modes(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(plain("response", b"one") + BAD[0] + plain("request", b"two") + BAD[4])
    (tmp_path / "b.warc.gz").write_bytes(record("response", b"three") + record("response", b"x" * 9999)[:-40])
    register(spark)
    load = lambda **o: spark.read.format("warc").options(**o).load(f"file://{tmp_path}")
    rows = load(mode="PERMISSIVE").collect()
    assert sorted(bytes(r.block) for r in rows if r.malformed is None) == [b"one", b"three", b"two"]
    assert sum(r.malformed is not None for r in rows) == 3 and all(r.block is None for r in rows if r.malformed)
    assert load(mode="permissive").where("malformed is not null").count() == 3
    assert load(mode="permissive").select("record_type").where("record_type = 'request'").count() == 1
    with pytest.raises(Exception, match="byte"):
        load().collect()
    with pytest.raises(Exception, match="mode"):
        load(mode="other").collect()


def test_repeated_headers_and_odd_ids(spark, tmp_path):
    assert parse_headers(b"A: 1\r\nB: x\r\n y\r\na:2") == {"a": "1, 2", "b": "x y"}
    pages_to_warc(spark.createDataFrame([("a-1", "u", "h", "z"), ("7", "u", "i", "z")], "page_id string, url string, html string, block string"), f"file://{tmp_path}/w")
    assert sorted((str(r.page_id), r.html) for r in responses(spark, f"file://{tmp_path}/w").collect()) == [("7", "i"), ("None", "h")]
