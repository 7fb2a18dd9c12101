import base64
import hashlib

from sensorweave.llm import warc


def _brute(rows):
    top = {}
    for k, _, h in rows:
        if k is not None:
            top[h or ""] = max(k, top.get(h or "", k))
    out = []
    for k, _, h in rows:
        p = (h or "").encode()
        first = k == top.get(h or "")
        out.append((k, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first else "revisit", None if first else top[h or ""]))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = [(i, f"http://h/{i}", "x" * (i % 7) + "é\r\n\r\n") for i in range(120)] + [(500, None, None), (501, "a\nb", ""), (502, "u", "q" * 300000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, k string").repartition(5)
    got = sorted((tuple(r) for r in warc.round_trip(spark, pages, roll_bytes=2000).collect()), key=str)
    assert got == _brute(rows)


def test_same_files_again_payloads_and_no_leftovers(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i % 50}</p>") for i in range(200)], "page_id long, url string, html string")
    seen = []
    for n in range(2):
        folder = f"file://{tmp_path}/{n}"
        entries = warc.write(pages.repartition(3 + n), folder, roll_bytes=3000)
        assert len(entries) > 3 and sum(e["records"] for e in entries) == 200
        names = sorted(x.name for x in (tmp_path / str(n)).iterdir())
        assert names == ["manifest.jsonl", *(e["name"] for e in entries)]
        seen.append([(tmp_path / str(n) / e["name"]).read_bytes() for e in entries])
        back = warc.read(spark, folder)
        assert {r.page_id: r.html for r in back.where("record_type = 'response'").collect()} == {i: f"<p>{i % 50}</p>" for i in range(150, 200)}
    assert seen[0] == seen[1]


def test_repeated_rows_null_keys_and_empty_tables(spark):
    pages = spark.createDataFrame([(7, "u", "a"), (7, "u", "a"), (None, "u", "a"), (None, "v", "z")], "page_id long, url string, html string")
    got = sorted((tuple(r) for r in warc.round_trip(spark, pages).select("page_id", "record_type", "refers_to").collect()), key=str)
    assert got == sorted([(7, "response", None), (7, "revisit", 7), (None, "revisit", 7), (None, "response", None)], key=str)
    assert warc.round_trip(spark, pages.limit(0)).collect() == []
    least = warc.round_trip(spark, pages, least_bytes=2)
    assert {r.record_type for r in least.collect()} == {"response"}


def test_far_off_keys_and_the_whole_range_of_longs(spark, tmp_path):
    ids = [*range(2000), 10**15, 2**63 - 1, -(2**63), None, None]
    pages = spark.createDataFrame([(i, "http://x.org", f"<p>{k}" * 9) for k, i in enumerate(ids)], "page_id long, url string, html string").repartition(5)
    files = warc.write(pages, f"{tmp_path}/w", parts=8)
    assert sum(f["records"] for f in files) == len(ids) and max(f["records"] for f in files) < 600
    firsts = [f["first"] for f in files]
    assert firsts == sorted(firsts, key=lambda x: (x is not None, x or 0)) and firsts[-1] is not None
    assert sorted(((r.page_id is not None, r.page_id or 0) for r in warc.read(spark, f"{tmp_path}/w").collect())) == sorted((i is not None, i or 0) for i in ids)


def test_one_common_payload_and_no_folder_left(spark, monkeypatch):
    import os

    from sensorweave.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    pages = spark.createDataFrame([(i, "http://x.org", "" if i % 3 else f"p{i // 9}") for i in range(300)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in warc.round_trip(spark, pages).collect()}
    assert len(rows) == 300 and all(rows[i].refers_to == (None if i == 299 else 299) for i in range(300) if i % 3)
    folder = common.shared_folder(spark).removeprefix("file:")
    assert not [x for x in os.listdir("/" + folder.lstrip("/")) if x.startswith("warc-")]
