"""WARC identifiers, and files bounded by bytes."""

import gzip
import io
from collections import Counter

from traceloom.llm import warc


def stored(path):
    return [r for p in path.glob("*.gz") for r in warc.read_warc(io.BytesIO(gzip.decompress(p.read_bytes())))]


def test_identifiers_are_unique_where_rows_repeat(spark, tmp_path):
    rows = [(1, "http://a.test/", "x" * 200)] * 5 + [(2, "http://b.test/", "x" * 200)] * 3 + [(1, "http://a.test/", "y" * 300), (None, None, "x" * 200), (None, None, "x" * 200), (7, "u", "short"), (7, "u", "short"), (8, "u", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    warc.write_archive(spark, df, str(tmp_path / "w"))
    records = [r for r in stored(tmp_path / "w") if r.get("WARC-Type") != "warcinfo"]
    ids = Counter(r.get("WARC-Record-ID") for r in records)
    assert len(records) == len(rows) and max(ids.values()) == 1
    responses = {r.get("WARC-Record-ID"): r.get("WARC-Payload-Digest") for r in records if r.get("WARC-Type") == "response"}
    revisits = [r for r in records if r.get("WARC-Type") == "revisit"]
    assert len(revisits) == 3 and all(responses[r.get("WARC-Refers-To")] == r.get("WARC-Payload-Digest") for r in revisits)
    got = Counter((r["id"], r["record_type"], r["refers_to"]) for r in warc.read_archive(spark, str(tmp_path / "w")).collect())
    assert got == Counter({(1, "response", None): 6, (2, "revisit", 1): 3, (None, "response", None): 2, (7, "response", None): 2, (8, "response", None): 1})


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 100_000)
    rows = [(k, f"http://a.test/{k}", f"{k} " + "z" * 10_000) for k in range(100)] + [(100, "u", "w" * 3_000_000)]
    warc.write_archive(spark, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1), str(tmp_path / "w"))
    sizes = [len(gzip.decompress(p.read_bytes())) for p in (tmp_path / "w").glob("*.gz")]
    assert len(sizes) > 10 and max(sizes) < 3_400_000 and sorted(sizes)[-2] < 400_000
    assert {r["id"] for r in warc.read_archive(spark, str(tmp_path / "w")).collect()} == set(range(101))
