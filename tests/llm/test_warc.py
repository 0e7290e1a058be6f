import base64
import hashlib

from codeloom.llm import warc

TRAP = "<p>x</p>WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\ntail WARC/1.0\r\nno"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows):
    first = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        first.setdefault(h or "", i)
    return sorted((str(i), len((h or "").encode()), digest(h), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, _, h in rows)


def result(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def test_round_trip_with_traps_and_repeats(spark):
    rows = [(1, "http://a/ b\r\nX: y", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "u", TRAP), (5, "u", "<p>é</p>"), (6, "u", TRAP), (7, "u", "WARC/1.0\r\n"), (8, "u", "\r\n\r\n" * 5), (None, "u", "null id")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert result(warc.round_trip(df)) == expected(rows)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_chains_across_many_blocks(spark):
    rows = [(i, f"http://h/{i}", TRAP * (i % 4) + "word " * (i * 7 % 50) + str(i // 2 if i % 10 < 2 else i)) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert result(warc.round_trip(df)) == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_short_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "a"), (2, "u", "a")], "page_id long, url string, html string")
    assert [r["record_type"] for r in warc.round_trip(df, least=2).collect()] == ["response", "response"]
