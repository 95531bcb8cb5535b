"""The report's graph is derived once."""

from causeway.plans import analysis
from causeway.plans.views import tables


def test_report_writes_its_graph_once(spark, sf_dir, monkeypatch):
    wrote, used = [], []
    monkeypatch.setattr(analysis, "written", lambda df: wrote.append(df) or df)
    monkeypatch.setattr(analysis.invariants, "evaluate", lambda t: used.append(t["graph"]["relations"]))
    monkeypatch.setattr(analysis.findings, "analyze", lambda t, results: used.append(t["graph"]["relations"]))
    analysis._report(tables(spark, sf_dir))
    assert len(wrote) == 1 and len(used) == 2 and all(u is wrote[0] for u in used)
