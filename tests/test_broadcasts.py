"""What grows with the input is joined by shuffles, not passed through the driver."""

from __future__ import annotations

from lodestone.operators import companies, ledger


def watched(monkeypatch, module):
    plans, own = [], ledger.written

    def written(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return own(df, label)

    monkeypatch.setattr(module, "written", written)
    return plans


def test_rounds_of_a_closure_broadcast_nothing(spark, monkeypatch):
    plans = watched(monkeypatch, ledger)
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")
    assert {r["root"] for r in ledger.closure(edges).collect()} == {0}
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)


def test_companies_broadcast_nothing(spark, monkeypatch):
    plans = watched(monkeypatch, companies)
    signals = spark.createDataFrame([(1, "DOMAIN", "a.example"), (2, "DOMAIN", "a.example"), (3, "NAME", "c"), (3, "APPLICATION_HOST", "h")], "company_id long, kind string, value string")
    out = companies.resolved(signals)
    assert sorted(map(tuple, out.collect())) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]
    assert not any("Broadcast" in p for p in [*plans, out._jdf.queryExecution().executedPlan().toString()])
