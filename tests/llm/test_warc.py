import base64
import hashlib
import random

from pyspark.sql import types as T

from quillon.llm.warc import read_records, ranges, resolve_revisits, scan_archive, write_archives

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                       T.StructField("sha1", T.StringType()), T.StructField("keep_id", T.StringType())])


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)


def test_round_trip(spark):
    r = random.Random(3)
    rows = [(i, f"http://a/{i}", r.choice(["<p>é</p>", "", None, "x" * 5000, f"own {i}\r\n\r\n"])) for i in range(40)]
    rows += [(40, None, "no url"), (None, "http://a/null", "<p>é</p>"), (41, "http://a/b c\r\nd", "u" * 200_000)]
    index = write_archives(pages(spark, rows))
    got = {x.page_id: x for x in resolve_revisits(read_records(index)).collect()}
    best = {}
    for i, _, html in rows:
        best[html or ""] = max(best.get(html or "", -1), -1 if i is None else i)
    assert len(got) == len(rows)
    for i, url, html in rows:
        x, body = got[i], (html or "").encode()
        assert x.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert x.payload_bytes == len(body) and bytes(x.payload) == body
        want = None if best[html or ""] == i else best[html or ""]
        assert (x.record_type, x.refers_to) == ("response" if want is None else "revisit", want)
    assert got[40].url is None and got[41].url == "http://a/b%20c%0D%0Ad"


def test_selected_records_and_plain_scan(spark):
    index = write_archives(pages(spark, [(i, f"http://a/{i}", f"page {i}") for i in range(30)]))
    some = read_records(index.where("page_id % 7 = 0")).collect()
    assert sorted(x.page_id for x in some) == [0, 7, 14, 21, 28]
    files = [x.file for x in index.select("file").distinct().collect()]
    heads = [h for f in files for h in scan_archive(spark, f)]
    assert sum(h["WARC-Type"] == "response" for h in heads) == 30


def test_empty_and_ties(spark):
    assert write_archives(spark.createDataFrame([], SCHEMA)).count() == 0
    index = write_archives(pages(spark, [(7, "u", "same"), (7, "u", "same"), (3, "u", "same")]))
    got = sorted((x.page_id, x.record_type, x.refers_to) for x in read_records(index, payload=False).collect())
    assert got == [(3, "revisit", 7), (7, "response", None), (7, "response", None)]


def test_ranges_join_neighbours():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 100, 5), ("b", 0, 5), ("b", 5, 50)]
    assert ranges(rows, 0, 100) == [("a", 0, 20, 0, 2), ("a", 100, 105, 2, 3), ("b", 0, 55, 3, 5)]
    assert ranges(rows, 80, 100)[0] == ("a", 0, 20, 0, 2)
    assert ranges(rows, 80, 200)[0] == ("a", 0, 105, 0, 3)
    assert ranges(rows, 0, 12)[3:] == [("b", 0, 5, 3, 4), ("b", 5, 55, 4, 5)]
