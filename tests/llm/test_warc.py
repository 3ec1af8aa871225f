import gzip
import hashlib

from pyspark.sql import functions as F

from tessera.llm.warc import WarcReader, archived, read_warc, write_pages

from .helpers import clashing, records

LONG = "<p>" + "long enough to be revisited " * 5 + "é</p>"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def rows():
    found = [(k, f"http://e.org/{k}?q=ü x\r\ny", f"<p>{k} é\n\r\n\r\n" + "x" * (k * 37 % 400)) for k in range(40)]
    found += [(60, "http://a", LONG), (55, "http://b", LONG), (58, None, LONG), (70, "u", None), (71, None, ""), (72, "u", "short"), (73, "u", "short")]
    return found + [(80, "big", "y" * 3_000_000)]


def test_round_trip(spark):
    got = archived(clashing(pages(spark, rows())).withColumn("record_type", F.lit("x"))).collect()
    by = {int(r["record_id"].split(":")[3]): r for r in got}
    assert len(got) == len(rows()) == len(by)
    for i, _, html in rows():
        payload = (html or "").encode()
        r = by[i]
        assert (r["payload_length"], r["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        if i in (58, 60):
            assert r["record_type"] == "revisit" and r["payload"] is None and r["refers_to"].endswith(":55")
        else:
            assert r["record_type"] == "response" and bytes(r["payload"]) == payload and r["refers_to"] is None
    assert by[3]["target_uri"] == "http://e.org/3?q=%C3%BC%20x%0D%0Ay"


def test_repeated_rows_and_null_ids_have_one_response(spark):
    again = [(5, "a", LONG), (5, "a", LONG), (None, "b", LONG), (None, None, None), (None, None, LONG + "2"), (None, None, LONG + "2")]
    got = archived(pages(spark, again)).collect()
    assert len(got) == len(again) and len({r["record_id"] for r in got}) == len(again)
    responses = {r["record_id"] for r in got if r["record_type"] == "response"}
    assert len(responses) == 3
    assert all(r["refers_to"] in responses for r in got if r["record_type"] == "revisit")
    assert archived(pages(spark, [])).count() == 0


def test_predicates_reach_the_reader(spark, tmp_path):
    path = str(tmp_path / "w")
    write_pages(pages(spark, rows()), path)
    whole = read_warc(spark, path)
    kept = whole.filter("record_type = 'revisit' AND payload_length > 10")
    assert kept.count() == 2
    assert whole.filter(F.col("payload_digest").isin(hashlib.sha256(b"short").hexdigest())).count() == 2
    assert whole.filter("target_uri LIKE 'http://e.org/1%'").count() == 11
    assert whole.filter("refers_to IS NOT NULL").count() == 2
    assert read_warc(spark, path, payload="false").filter("payload IS NOT NULL").count() == 0


def test_unwanted_blocks_are_stepped_over(tmp_path, spark):
    path = str(tmp_path / "w")
    write_pages(pages(spark, rows()), path)
    reader = WarcReader({"path": path})
    reader.tests = [("warc-type", "EqualTo", "revisit")]
    found = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in found) == 2


def test_files_of_other_writers(tmp_path, spark):
    def record(kind, body, extra=""):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{len(body)}>\r\n{extra}Content-Length: {len(body)}\r\n\r\n"
        return head.encode() + body + b"\r\n\r\n"

    records_ = [record("warcinfo", b"software: x\r\n"), record("response", b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello", "WARC-Target-URI: http://x\r\n"), record("request", b"GET / HTTP/1.1\r\n\r\n")]
    (tmp_path / "a.warc").write_bytes(b"".join(records_))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records_)))
    (tmp_path / "c.txt").write_text("not an archive")
    df = read_warc(spark, str(tmp_path))
    assert records(df, "record_type", "payload_length") == sorted([("warcinfo", 13), ("response", 5), ("request", 18)] * 2, key=repr)
    assert [bytes(r["payload"]) for r in df.filter("record_type = 'response'").collect()] == [b"hello"] * 2


def warc(*blocks, kind="response", length=None):
    """Records as another writer makes them, of blocks without HTTP headers."""
    found = b""
    for k, block in enumerate(blocks):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{k}>\r\nContent-Length: {len(block) if length is None else length}\r\n\r\n"
        found += head.encode() + block + b"\r\n\r\n"
    return found


BLOCKS = [b"one", b"", b"two\r\n\r\nWARC/ within", b"x" * 200_000, b"last"]


def test_archives_of_other_writers(spark, tmp_path):
    whole = warc(*BLOCKS)
    cut = [whole[a : a + 70_001] for a in range(0, len(whole), 70_001)]
    made = {
        "plain.warc": whole,
        "one.warc.gz": gzip.compress(whole),  # one member for all records
        "each.warc.gz": b"".join(gzip.compress(warc(b)) for b in BLOCKS),
        "pairs.warc.gz": gzip.compress(warc(*BLOCKS[:2])) + gzip.compress(warc(*BLOCKS[2:])),
        "across.warc.gz": b"".join(map(gzip.compress, cut)),  # records over several members
        "padded.warc.gz": gzip.compress(whole) + b"\0" * 100,
        "lines.warc": b"\r\n\r\n" + whole.replace(b"\r\n\r\nWARC/1.0", b"\r\n\r\n\r\n\r\nWARC/1.0"),
    }
    for file, data in made.items():
        (tmp_path / file).mkdir()
        (tmp_path / file / file).write_bytes(data)
        found = read_warc(spark, str(tmp_path / file)).collect()
        assert sorted(bytes(r["payload"]) for r in found) == sorted(BLOCKS), file
        assert read_warc(spark, str(tmp_path / file)).filter("record_type = 'request'").count() == 0
        assert read_warc(spark, str(tmp_path / file)).filter("record_id = 'urn:1'").count() == (0 if file.startswith("each") else 2 if file.startswith("pairs") else 1)


def test_records_without_a_sound_length_are_shown(spark, tmp_path):
    data = warc(b"good") + warc(b"bad one WARC/ x\nWARC is no record", length="x") + warc(b"good again") + warc(b"", length="-1") + warc(b"end")
    for file, made in (("a.warc", data), ("b.warc.gz", gzip.compress(data))):
        (tmp_path / file).write_bytes(made)
        found = read_warc(spark, str(tmp_path / file)).collect()
        assert [(r["payload"] and bytes(r["payload"]), r["payload_length"]) for r in found] == [(b"good", 4), (None, None), (b"good again", 10), (None, None), (b"end", 3)]


def test_overwriting_leaves_the_old_until_the_end(spark, tmp_path):
    path = str(tmp_path / "w")
    write_pages(pages(spark, rows()), path)
    before = {f.name for f in (tmp_path / "w").iterdir()}
    broken = read_warc(spark, path).withColumn("payload", F.raise_error(F.lit("stop")).cast("binary"))
    try:
        broken.write.format("warc").mode("overwrite").option("path", path).save()
        raise AssertionError("it should have failed")
    except Exception as error:
        assert "stop" in str(error)
    assert {f.name for f in (tmp_path / "w").iterdir() if not f.name.startswith(".")} == {f for f in before if not f.startswith(".")}
    one = spark.createDataFrame([("r", "response", None, "u", "d", 1, b"z")], "record_id string, record_type string, refers_to string, target_uri string, payload_digest string, payload_length long, payload binary")
    one.write.format("warc").mode("overwrite").option("path", path).save()
    assert [r["record_id"] for r in read_warc(spark, path).collect()] == ["r"]
