"""Archives: exact round trips, and what the reader salvages from damage of all kinds."""

import gzip
import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from provender.llm import warc
from provender.llm.common import shared_dir

FIXED = "1970-01-01T00:00:00Z"


def payload_of(i):
    rng = np.random.default_rng(i)
    return rng.integers(0, 256, int(rng.integers(0, 3000)), np.uint8).tobytes() + b"<p>" * i


def records_of(n):
    return [warc.record_of(f"urn:r:{i}", f"http://a/{i}", FIXED, payload_of(i), None if i % 4 else f"urn:r:{i + 1}") for i in range(n)]


def read(data):
    """Rows of an archive in memory: (start, end, id or None, reason); they have to be the whole of it."""
    source = warc.Held(data)
    out, at = [], 0
    for start, end, _, _, x in warc.salvaged(source):
        assert start == at
        at = end
        out.append((start, end, None, x) if isinstance(x, str) else (start, end, int(x["fields"]["warc-record-id"][7:-1]), None))
    assert at == len(data)
    return out


@pytest.mark.parametrize("packed", [False, True])
def test_whole_archives(packed):
    parts = [gzip.compress(x) if packed else x for x in records_of(30)]
    got = read(b"".join(parts))
    assert [x[2] for x in got] == list(range(30)) and [e - s for s, e, *_ in got] == [len(p) for p in parts]
    assert read(b"") == []


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("kind", ["flip", "cut", "insert", "zero", "drop"])
def test_damage(packed, kind):
    """Whatever is done to some records, all others come back, and the gaps are what is left."""
    for seed in range(25):
        rng = np.random.default_rng(seed)
        parts = [gzip.compress(x, mtime=0) if packed else x for x in records_of(16)]
        hurt = sorted(rng.choice(16, 4, replace=False).tolist())
        for i in hurt:
            p, at = parts[i], int(rng.integers(0, len(parts[i]) - 8))
            parts[i] = {"flip": p[:at] + bytes([p[at] ^ 0x40]) + p[at + 1 :], "cut": p[:at], "insert": b"\x1f\x8b\x08junk WARC/1.1\r\nnothing" + p, "zero": p[:at] + bytes(8) + p[at + 8 :], "drop": p[at:]}[kind]
        rows = read(b"".join(parts))
        got = [x[2] for x in rows if x[2] is not None]
        whole = [i for i in range(16) if kind == "insert" or i not in hurt]
        if kind != "insert":
            assert set(whole) <= set(got) <= set(range(16)), (seed, kind)
        else:
            assert got == whole
        # a header field that no check covers may change unseen; everything else is a gap
        assert all(x[3] for x in rows if x[2] is None) and (len(rows) > len(got) or not packed or kind == "cut")


def test_gaps_are_exact():
    parts = records_of(6)
    hurt = parts[2].replace(b"Content-Length: ", b"Content-Lxngth: ")
    assert [x[2] for x in read(b"".join([*parts[:2], hurt, *parts[3:]]))] == [0, 1, None, 3, 4, 5]
    rows = read(b"".join([*parts[:2], hurt, *parts[3:]]))
    assert rows[2][:2] == (len(b"".join(parts[:2])), len(b"".join(parts[:2])) + len(hurt)) and "content-length" in rows[2][3]
    # a payload that holds a whole record, with its own digest wrong: the record inside is no record of the archive
    inside = warc.record_of("urn:r:99", None, FIXED, b"inner", None)
    outer = warc.record_of("urn:r:1", None, FIXED, b"before" + inside + b"after", None)
    assert [x[2] for x in read(parts[0] + outer + parts[2])] == [0, 1, 2]
    assert [x[2] for x in read(parts[0] + outer.replace(b"after", b"AFTER") + parts[2])] == [0, None, 2]
    # two hurt members in a row are two gaps; several records in a member
    bad = gzip.compress(parts[1].replace(b"HTTP/1.1 200", b"HTTP/1.1 404"))
    assert [x[2] for x in read(gzip.compress(parts[0]) + bad + bad + gzip.compress(parts[3]))] == [0, None, None, 3]
    assert [x[2] for x in read(gzip.compress(parts[0] + parts[1]) + gzip.compress(b"") + gzip.compress(parts[3]))] == [0, 1, None, 3]
    inner = list(warc.salvaged(warc.Held(gzip.compress(parts[0] + b"junk" + parts[1]))))
    assert [(b - a, x if isinstance(x, str) else None) for _, _, a, b, x in inner] == [(len(parts[0]), None), (4, "no version line"), (len(parts[1]), None)]
    assert [x[2] for x in read(b"junk" + parts[0] + b"WARC/1.1\r\n" * 5000)] == [None, 0, None]


def test_windows(monkeypatch):
    """The same through a small window, over marks that lie across its edges."""
    monkeypatch.setattr(warc, "WINDOW", 64)
    import io

    for packed in (False, True):
        data = b"x" * 61 + b"".join(gzip.compress(x) if packed else x for x in records_of(12)) + b"WARC/1."
        source = warc.Bytes(io.BytesIO(data), len(data))
        got = [x["fields"]["warc-record-id"] if isinstance(x, dict) else None for *_, x in warc.salvaged(source)]
        assert got == [None, *(f"<urn:r:{i}>" for i in range(12)), None]


@pytest.mark.parametrize("packed", [False, True])
def test_round_trip(spark, packed):
    """Any payload, ids and addresses, small archives, nulls and repeated rows; damage in one file of several."""
    rows = [(f"urn:x:{i}", f"http://h/{i} \r\nü" if i % 3 else None, None if i % 2 else "2020-02-02T02:02:02Z", payload_of(i) if i % 7 else None, None if i % 5 else "urn:x:0") for i in range(80)]
    rows.append(rows[1])
    docs = spark.createDataFrame(rows, "record_id string, uri string, date string, payload binary, refers_to string").withColumns({c: F.lit(1) for c in ("file", "gap", "length", "_same")})
    path = f"{shared_dir(spark)}/test-{packed}"
    files = warc.write_archives(docs.repartition(3), path, size=20_000, compressed=packed)
    assert files.count() > 3 and sum(r["n_records"] for r in files.collect()) == 81
    records, gaps = warc.salvage(files)
    want = sorted((i, u and u.replace(" ", "%20").replace("\r", "%0D").replace("\n", "%0A"), d or FIXED, (p or b"") if r is None else None, r, len(p or b""), hashlib.sha1(p or b"").hexdigest()) for i, u, d, p, r in rows)
    key = lambda r: (r["record_id"], r["uri"], r["date"], None if r["payload"] is None else bytes(r["payload"]), r["refers_to"], r["payload_bytes"], r["payload_digest"])
    assert sorted(map(key, records.collect()), key=repr) == sorted(want, key=repr) and gaps.count() == 0
    assert sorted(map(key, warc.salvage(warc.archives(spark, path))[0].collect()), key=repr) == sorted(want, key=repr)

    hurt = files.first()["file"].removeprefix("file://")
    data = bytearray(open(hurt, "rb").read())
    before = records.where(F.col("file") == files.first()["file"]).count()
    data[len(data) // 2] ^= 0xFF
    open(hurt, "wb").write(data)
    left, gaps = warc.salvage(files)
    assert left.count() == 80 and gaps.count() == 1 and left.where(F.col("file").endswith(hurt)).count() == before - 1
    gap = gaps.first()
    assert gap["start"] <= len(data) // 2 < gap["start"] + gap["length"] and gap["gap"]


def test_revisits(spark):
    """Largest ids answer, small payloads always do; null ids, null pages and repeated rows."""
    big, small = b"b" * 1000, b"s" * 999
    rows = [(1, big), (5, big), (3, big), (None, big), (7, small), (8, small), (9, None), (10, None), (11, b"c" * 1000), (5, big), (None, b"n" * 1000), (None, b"n" * 1000), ((1 << 60) + 1, b"l" * 2000), ((1 << 60) + 3, b"l" * 2000)]
    docs = spark.createDataFrame(rows, "page_id long, payload binary").withColumn("refers_to", F.lit("own"))
    got = sorted(((r["page_id"], bytes(r["payload"] or b"")[:1], r["refers_to"]) for r in warc.with_revisits(docs, "page_id").collect()), key=repr)
    assert got == sorted([(1, b"b", 5), (5, b"b", None), (3, b"b", 5), (None, b"b", 5), (7, b"s", None), (8, b"s", None), (9, b"", None), (10, b"", None), (11, b"c", None), (5, b"b", None), (None, b"n", None), (None, b"n", None), ((1 << 60) + 1, b"l", (1 << 60) + 3), ((1 << 60) + 3, b"l", None)], key=repr)


def test_no_rows(spark):
    none = spark.createDataFrame([], "record_id string, uri string, date string, payload binary, refers_to string")
    records, gaps = warc.salvage(warc.write_archives(none, f"{shared_dir(spark)}/none"))
    assert records.count() == 0 and gaps.count() == 0


def test_query(spark, sf_dir, tmp_path):
    """Against SQL, over pages of which many are copies, some null, and their ids beside a null one."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    more = pages.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + (1 << 60))
    odd = spark.createDataFrame([(-4, None, None), (-5, "u", "x" * 999), (-6, "u", "x" * 999), (-7, "u", "é" * 500), (-8, "u", "é" * 500)], pages.schema)
    for name, df in (("given", pages), ("copies", pages.union(more).union(odd))):
        at = f"{tmp_path}/{name}"
        df.write.parquet(f"{at}/pages.parquet")
        got = sorted(map(tuple, warc.op11_warc(spark, at).collect()))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{at}/pages.parquet/*.parquet')")
        assert got == sorted(con.execute(warc.OP11_SQL).fetchall())
    assert sum(r[3] == "revisit" for r in got) > 15 and re.fullmatch("[0-9a-f]{40}", got[0][2])
