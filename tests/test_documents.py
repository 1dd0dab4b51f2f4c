"""Streamed call documents against whole ones."""

import gzip
import io as bytes_io
import json
import random
import subprocess
import sys

import pytest

from callquality.sources import documents as D
from callquality.sources import io


def some_value(rnd, depth=0):
    kind = rnd.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return rnd.choice([None, True, False, 1, -2.5e9])
    if kind < 4:
        return "".join(rnd.choice('ab"\\{}[],: é\n ') for _ in range(rnd.randrange(8)))
    if kind < 6:
        return {some_value_key(rnd): some_value(rnd, depth + 1) for _ in range(rnd.randrange(4))}
    return [some_value(rnd, depth + 1) for _ in range(rnd.randrange(4))]


def some_value_key(rnd):
    return "".join(rnd.choice('kx"\\}{,:') for _ in range(rnd.randrange(4)))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 100_000])
def test_members_of_any_document(size):
    rnd = random.Random(size)
    for n in range(40):
        section = {f"{some_value_key(rnd)}{k}": some_value(rnd) for k in range(rnd.randrange(5))}
        members = [("SampleParameters", {"SampleId": f'S"{n}'}), ("LocusResults", section), ("Other", some_value(rnd)), ("More", {"LocusResults": {"no": 1}})]
        rnd.shuffle(members)
        members = members if n % 5 else [m for m in members if m[0] != "SampleParameters"]
        text = json.dumps(dict(members), indent=rnd.choice([None, 1]), ensure_ascii=rnd.random() < 0.5).encode()
        data = gzip.compress(text[: len(text) // 2]) + gzip.compress(text[len(text) // 2 :]) if n % 2 else text
        got = list(D.read_members(lambda data=data: bytes_io.BytesIO(data), size=size))
        assert [json.loads(t) for _, t in got] == list(section.values())
        assert {s for s, _ in got} <= {f'S"{n}' if n % 5 else None}


def test_broken_documents():
    for data in (b'{"LocusResults": {"a": {"x": 1}', b"", b"[1, 2]"):
        with pytest.raises(ValueError, match="ends early"):
            list(D.read_members(lambda data=data: bytes_io.BytesIO(data)))
    with pytest.raises(ValueError, match="gzip"):
        list(D.read_members(lambda: bytes_io.BytesIO(gzip.compress(b'{"LocusResults": {}}')[:-9])))
    for data in (b'{"LocusResults": null}', b"{}", b' {"LocusResults" : { } , "x": [1,{"y":2}]} '):
        assert not list(D.read_members(lambda data=data: bytes_io.BytesIO(data)))


def test_equals_the_whole_reader(spark, tmp_path):
    def locus(k):
        variant = {"RepeatUnit": "CAG", "ReferenceRegion": f"chr1:{k}-{k + 30}", "Genotype": "20/97", "CountsOfSpanningReads": "(20, 8), (97, 1)", "AlleleQualityMetrics": {"Alleles": [{"AlleleNumber": 1, "AlleleSize": 20, "Depth": 11.0}]}}
        return {"LocusId": f"l{k}", "Coverage": 30.0, "ReadLength": 150.0, "Variants": {f"l{k}": variant}}

    for n in range(3):
        doc = {"SampleParameters": {"SampleId": f"S{n}", "Sex": "F"}, "LocusResults": {f"l{k}": locus(k) for k in range(300)}}
        doc = doc if n else dict(reversed(doc.items()))
        data = json.dumps(doc, indent=n).encode()
        (tmp_path / f"d{n}.json{'.gz' if n == 1 else ''}").write_bytes(gzip.compress(data) if n == 1 else data)
    (tmp_path / "_SUCCESS").write_text("")
    whole, streamed = io.read_call_documents(spark, str(tmp_path)), D.stream_call_documents(spark, str(tmp_path))
    assert streamed.rdd.getNumPartitions() == 3
    key = lambda df: sorted(map(repr, df.withColumnRenamed("source_file", "f").selectExpr("regexp_extract(f, '[^/]*$', 0) AS f", "sample_id", "locus").collect()))
    assert key(streamed) == key(whole) and streamed.count() == 900
    assert D.stream_call_documents(spark, f"{tmp_path}/d[02].json").count() == 600
    assert io.allele_rows(io.variant_rows(streamed)).count() == 1800
    assert sorted(r["source_file"] for r in streamed.select("source_file").distinct().collect()) == [f"file://{tmp_path}/d{n}.json{'.gz' if n == 1 else ''}" for n in range(3)]
    (tmp_path / "e").mkdir()
    assert D.stream_call_documents(spark, f"{tmp_path}/e").count() == 0


def test_memory_does_not_grow_with_the_document(tmp_path):
    code = """
import gzip, json, resource, sys
from callquality.sources.documents import read_members
path, n = sys.argv[1], int(sys.argv[2])
one = json.dumps({"LocusId": "x" * 400, "Variants": {"v": {"Genotype": "1/2", "s": "y" * 500}}})
with gzip.open(path, "wt", compresslevel=1) as f:
    f.write('{"SampleParameters": {"SampleId": "S"}, "LocusResults": {')
    for k in range(n):
        f.write(("," if k else "") + f'"k{k}": {one}')
    f.write("}}")
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
print(sum(1 for _ in read_members(lambda: open(path, "rb"))), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    took = []
    for n in (3_000, 60_000):
        count, rise = map(int, subprocess.run([sys.executable, "-c", code, str(tmp_path / "big.gz"), str(n)], capture_output=True, text=True, check=True, env={"PYTHONPATH": ":".join(sys.path)}).stdout.split())
        assert count == n
        took.append(rise)
    assert took[1] < took[0] + 20_000  # KB, for 20 times the document
