import duckdb
import pytest

from granary.llm import mixing
from granary.llm.common import documents


def sainte_lague(targets, seats):
    """Seats one by one."""
    held = [0] * len(targets)
    for _ in range(seats):
        best = max(range(len(targets)), key=lambda k: (targets[k] / (2 * held[k] + 1), -k))
        held[best] += 1
    return held


def water_fill(sizes, weights, most=3):
    """Targets by resharing the excess until none is above its cap."""
    total, caps = float(sum(sizes)), [most * s for s in sizes]
    got, free, left = [0.0] * len(sizes), set(range(len(sizes))), total
    while free:
        share = left / sum(weights[k] for k in free)
        over = {k for k in free if share * weights[k] > caps[k]}
        if not over:
            for k in free:
                got[k] = share * weights[k]
            break
        for k in over:
            got[k] = float(caps[k])
            left -= caps[k]
        free -= over
    return got


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 5, 7, 300, 2], [10], [0, 50, 1], [3, 3, 3, 9000]])
def test_targets(spark, sizes):
    totals = spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(sizes)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(totals).collect()}
    wanted = water_fill(sizes, [k % 3 + 1 for k in range(len(sizes))])
    assert [got[f"s{k}"] for k in range(len(sizes))] == pytest.approx(wanted)


def test_allotment(spark):
    targets = [1000.0, 700.5, 64.0, 33.3, 10.0, 2500.25, 7.0]
    shares = spark.createDataFrame([(f"s{k}", k + 1, t) for k, t in enumerate(targets)], "source string, rank int, target double")
    rows = mixing.allot(shares, block=16, shards=5).collect()
    blocks = round(sum(targets) / 16)
    held = {(r["rank"] - 1, r["shard"]): r["first_block"] + r["quota"] for r in rows}
    for shard in range(1, 6):
        assert [held[k, shard] for k in range(len(targets))] == sainte_lague(targets, blocks * shard // 5)
    assert all(r["quota"] >= 0 for r in rows)


def test_mix(spark, frame):
    rows = [(k, "w " * (k % 7), "a" if k % 3 else None if k % 2 else "b") for k in range(600)] + [(None, "x y z", "c"), (None, None, "c"), (9, "w w", "a")]
    docs = frame(rows)
    got = mixing.mix(docs, block=8).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7), block=8).collect()), key=str)
    by_target = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by_target.setdefault((r["target"], r["source_size"]), []).append(r["taken"])
    for (target, size), taken in by_target.items():
        assert abs(sum(taken) - target) <= 8 and target <= 3 * size
    assert sum(t for t, _ in by_target) == pytest.approx(sum(r["size"] for r in got))
    assert mixing.mix(frame([])).collect() == [] and mixing.mixture(frame([])).collect() == []
    assert [r["taken"] for r in mixing.mix(frame([(1, ""), (2, None)])).collect()] == [0, 0]


def test_mixture_follows_the_mix(spark, frame):
    docs = frame([(k, " ".join(f"w{k}" for _ in range(1 + k % 9)), f"s{k % 5}") for k in range(400)])
    times = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in mixing.mix(docs).collect()}
    rows = mixing.mixture(docs)
    assert rows.columns == docs.columns
    got = {}
    for r in rows.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: n for k, n in times.items() if n}


def test_plan_has_no_python(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    plan = mixing.mixture(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_oracle(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    got = mixing.mix(documents(spark, data))
    wanted = con.execute(mixing.ORACLE)
    assert [d[0] for d in wanted.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(wanted.fetchall())
