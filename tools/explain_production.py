"""Physical plans of the flagship on production-layout tables -> PLANS.md.

Writes the logical tables derived from the driver data in their production layout
(events partitioned by ``event_date``, a flattened "silver" copy, leads, phone
map, sink partitioned by ``created_date``) to a fresh scratch folder, runs the
attribution on them, checks the answer equals the fixture-based query, and
records what each scan reads (partition filters, pushed filters, read schema) and
the operator tree.

    python tools/explain_production.py [sf_dir] [out.md]
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def scans(plan: str) -> list[str]:
    out = []
    for block in re.split(r"\n(?=\(\d+\) )", plan):
        if block.startswith("(") and "Scan parquet" in block.splitlines()[0]:
            keep = [ln for ln in block.splitlines()
                    if ln.startswith(("(", "Location", "PartitionFilters", "PushedFilters", "ReadSchema"))]
            out.append("\n".join(keep))
    return out


def tree(plan: str) -> str:
    """The final adaptive plan only (the initial plan is dropped)."""
    head = plan.split("\n\n\n")[0]
    return head.split("+- == Initial Plan ==")[0]


def main(argv):
    from touchpoint.operators import attribution as A
    from touchpoint.operators import audience as AU
    from touchpoint.operators.incremental import append_matched, read_sink
    from touchpoint.plans import catalog as C
    from touchpoint.session import get_session
    from touchpoint.sources import fixtures as FX
    from touchpoint.sources import schemas as S
    from touchpoint.sources.tables import read_events, read_flat_events, read_table, write_events, write_silver_events

    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    out_md = argv[2] if len(argv) > 2 else "PLANS.md"
    root = tempfile.mkdtemp(prefix="run-plans-", dir="/tmp")
    spark = get_session("local[8]", shuffle_partitions=8)

    write_events(FX.ga_events(spark, sf), f"{root}/events", "overwrite", 4)
    write_silver_events(FX.ga_events(spark, sf), f"{root}/events_silver", "overwrite", 4)
    FX.test_drive_leads(spark, sf).write.parquet(f"{root}/leads")
    FX.phone_map(spark, sf).write.parquet(f"{root}/phone_map")
    append_matched(FX.matched_sink(spark, sf), f"{root}/sink")

    leads = read_table(spark, f"{root}/leads", S.LEADS)
    pm = read_table(spark, f"{root}/phone_map", S.PHONE_MAP)
    sink = read_sink(spark, f"{root}/sink")
    raw_events = read_events(spark, f"{root}/events")
    silver_events = read_flat_events(spark, f"{root}/events_silver")

    sections = []
    expected = C.QUERIES["attribute_test_drive"](spark, sf)
    exp_rows = sorted(map(tuple, expected.collect()), key=repr)
    for label, ev in [("raw events (nested parameter list)", raw_events),
                      ("silver events (flat parameter columns)", silver_events)]:
        df = A.attribute_test_drive(A.AttributionInputs(leads, ev, pm, sink), C.AS_OF,
                                    C.LOOKBACK_DAYS)
        got = sorted(map(tuple, df.collect()), key=repr)
        assert got == exp_rows, f"{label}: production-layout result differs"
        plan = df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        sections.append((f"attribute_test_drive on {label}", plan, len(got)))

    journey = C._journey(spark, sf)
    seg = AU.segment_counts(journey, FX.active_customers(spark, sf))
    seg.collect()
    plan = seg._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    sections.append(("segment_counts (one-pass touch segments)", plan, seg.count()))

    lines = [
        "# PLANS",
        "",
        f"Generated by `tools/explain_production.py {sf}` on production-layout tables "
        "written to a scratch folder (events partitioned by `event_date`). The results "
        "equal the fixture-based registered query. For each plan: what every Parquet "
        "scan reads, then the final adaptive operator tree after execution (AQE turned "
        "shuffled joins whose measured input was small into broadcast joins; at scale "
        "the same joins stay sort-merge joins, with skewed partitions split).",
        "",
        "What to look for: the lead scan carries the load window as `PushedFilters` on",
        "the raw UTC column and reads only the used leaves of the `customer` struct; the",
        "events scans carry the day range as `PartitionFilters`; on silver events the",
        "`ReadSchema` is four flat columns instead of the whole parameter list; there is",
        "no `BroadcastNestedLoopJoin` and no single-partition exchange; the ranking is cut",
        "by a `WindowGroupLimit` before its exchange; the event window is read once, beside",
        "the pass over the conversion events (filtered by name at the scan).",
        "",
    ]
    for title, plan, n in sections:
        lines += [f"## {title}", "", f"rows: {n}", "", "### Scans", "", "```"]
        lines += scans(plan) or ["(none)"]
        lines += ["```", "", "### Operator tree", "", "```", tree(plan), "```", ""]
        ops = tree(plan)
        lines += [
            "Counts: " + ", ".join(
                f"{k}={ops.count(k)}" for k in
                ["Exchange", "HashAggregate", "SortAggregate", "SortMergeJoin",
                 "BroadcastHashJoin", "Window", "BroadcastNestedLoopJoin", "Scan parquet"]
            ),
            "",
        ]
    with open(out_md, "w") as fh:
        fh.write("\n".join(lines))
    print("wrote", out_md, "scratch", root)


if __name__ == "__main__":
    main(sys.argv)
