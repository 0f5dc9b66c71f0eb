"""Records that are assembled slice by slice of the files are those of one pass."""

from binlens.operators import vector as vec
from binlens.plans import q_vector as qv
from binlens.sources import records

from scales import SF_SMALL


def test_slices_give_the_same_records(spark, monkeypatch):
    def all_of():
        a = records.raw_records(spark, SF_SMALL).collect()
        b = qv._with_warnings(spark, SF_SMALL).collect()
        c = qv.q_vectorize_all(spark, SF_SMALL).collect()
        return [sorted(x, key=str) for x in (a, b, c)]

    whole = all_of()
    lines = records._count_lines(spark, SF_SMALL)
    assert lines <= records.LINES_PER_SLICE
    monkeypatch.setattr(records, "LINES_PER_SLICE", -(-lines // 3))
    written, write = [], records.shared_path
    monkeypatch.setattr(records, "shared_path", lambda *a: written.append(a[1]) or write(*a))
    assert all_of() == whole
    assert written == ["files-A", "files-B", "files-B"]
    plan = vec.vectorize_long(qv._with_warnings(spark, SF_SMALL), "file_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # the stored rows need no further shuffle


def test_wide_columns_are_made_after_the_joins(spark):
    plan = str(records.raw_records_b(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan())
    join = plan.index("Join LeftOuter")
    assert "label#" in plan[:join] and "label#" not in plan[join:] and "o_totalprice#" in plan[join:]


def test_mixed_shards_are_compressed_and_go_by_slice(spark, monkeypatch):
    """Each file is in the shards once, in its layout; the shards of a slice are deleted when its rows are stored."""
    import os
    from urllib.parse import urlparse

    from binlens.plans import q_layout as ql
    from binlens.sources import io

    whole = sorted(ql.q_normalize_layout_mixed(spark, SF_SMALL).collect(), key=str)
    monkeypatch.setattr(records, "LINES_PER_SLICE", 4000)
    sinks, sink, names = [], io.sink_jsonl, []

    def sunk(df, path, **b):
        sink(df, path, **b)
        sinks.append(urlparse(path).path)
        names.extend(f for f in os.listdir(sinks[-1]) if f.startswith("part-"))

    monkeypatch.setattr(io, "sink_jsonl", sunk)
    assert sorted(ql.q_normalize_layout_mixed(spark, SF_SMALL).collect(), key=str) == whole
    assert len(sinks) == 4 and not any(os.path.exists(p) for p in sinks)
    assert names and all(f.endswith(".json.gz") for f in names)
