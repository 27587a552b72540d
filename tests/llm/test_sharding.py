import zlib

import numpy as np
import pytest

from touchpoint.llm import sharding


def test_curve_visits_every_cell_once_by_single_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2), (1, 5)):
        axes = np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")
        cells = np.stack([a.ravel() for a in axes], 1)
        index = sharding.hilbert_index(cells, bits)
        assert sorted(index) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(1)
        assert (steps == 1).all()


def hold(rows, got, shards):
    assert len(got) == len(rows)
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    slots = {}
    for r in got:
        assert 0 <= r["shard"] < shards and r["law"] == "rows" and r["grown_shard"] is None
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(k, [])) for k in range(shards)]
    assert max(counts) - min(counts) <= 1


@pytest.mark.parametrize("bucket", [50_000, 3])
def test_law_of_rows(make_docs, odd_rows, prose, monkeypatch, bucket):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket)
    rows = odd_rows + [(100 + k, prose(k, 5 + k % 40), "en" if k % 3 else None, f"s{k % 7}" if k % 5 else None) for k in range(200)] + [(500 + k, "copy", "en", "hot") for k in range(90)]
    got = sharding.shard(make_docs(rows, clashing=True), 7).collect()
    hold(rows, got, 7)
    by_curve = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in by_curve] == sorted(r["curve"] for r in by_curve)


def test_fewer_rows_than_shards(make_docs):
    rows = [(1, "a"), (2, None), (2, None)]
    hold(rows, sharding.shard(make_docs(rows)).collect(), 40)
    assert sharding.shard(make_docs([])).count() == 0


def test_shards_are_narrow_in_every_dimension(make_docs, prose):
    rows = [(k, prose(k, 3 + (k * 37) % 90), ["de", "en", "es", "fr"][k % 4], f"src{(k // 4) % 16:02d}") for k in range(1024)]
    got = sharding.shard(make_docs(rows), 32).collect()
    lang, source = ({i: r[k] for i, *r in rows} for k in (1, 2))
    for of, most in ((lang, 4), (source, 16)):
        seen = {}
        for r in got:
            seen.setdefault(r["shard"], set()).add(of[r["doc_id"]])
        assert np.mean([len(s) for s in seen.values()]) <= 0.7 * most


def sources_per_shard(make_docs, prose, names):
    rows = [(k, prose(k % 50, 3 + (k * 37) % 90), "en", names[k % len(names)]) for k in range(1200)]
    source, seen = {i: s for i, *_, s in rows}, {}
    for r in sharding.shard(make_docs(rows), 24).collect():
        seen.setdefault(r["shard"], set()).add(source[r["doc_id"]])
    return np.mean([len(s) for s in seen.values()])


def test_long_common_beginnings_prune_as_short_names_do(make_docs, prose):
    short = sources_per_shard(make_docs, prose, [f"s{k}" for k in range(10)])
    long = sources_per_shard(make_docs, prose, [f"https://commoncrawl.example.org/crawl-{k}" for k in range(10)])
    assert long == short < 4


def test_ranks_of_whole_values(spark):
    values = [f"{'x' * 40}{k:05d}" for k in range(3000)] + [None, "", "é"]
    got = {r["value"]: r["code"] for r in sharding.ranks(spark.createDataFrame([(v,) for v in values * 2], "source string").repartition(5), "source").collect()}
    assert got == {v: k + 1 for k, v in enumerate(sorted(v for v in values if v is not None))}


def test_equal_rows_are_spread_over_buckets(make_docs, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    rows = [(None, "copy", "en", "hot")] * 600 + [(k, f"t{k}", "en", "hot") for k in range(600)]
    hold(rows, sharding.shard(make_docs(rows), 7).collect(), 7)


def test_written_shards_hold_all_rows(spark, make_docs, odd_rows, scratch):
    docs = make_docs(odd_rows)
    sharding.write_shards(docs, f"{scratch}/out", 3, file_rows=2)
    back = spark.read.parquet(f"{scratch}/out")
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert back.select("shard").distinct().count() == 3
