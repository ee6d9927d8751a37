"""Summarise the executed physical plan of every catalog query (PLANS.md).

For each query: file scans with pushed / partition filters and read columns,
shuffle exchanges by kind, broadcasts, window group limits and sort-merge
joins, read from the final adaptive plan after a full run (noop sink).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from adega.plans import catalog  # noqa: E402
from adega.session import build_session  # noqa: E402


def final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    text = df._jdf.queryExecution().executedPlan().toString()
    text = re.sub(r"#\d+L?", "", text)
    if "== Final Plan ==" in text:  # keep the re-optimised plan only
        text = text.split("== Final Plan ==", 1)[1].split("== Initial Plan ==", 1)[0]
    return text


def bracketed(line: str, key: str) -> str | None:
    """Content of ``key: [...]`` with nested brackets balanced."""
    start = line.find(key + ": [")
    if start < 0:
        return None
    i = start + len(key) + 3
    depth, j = 1, i
    while j < len(line) and depth:
        depth += {"[": 1, "]": -1}.get(line[j], 0)
        j += 1
    return line[i:j - 1]


def table_name(path: str) -> str:
    """Last path component above any partition folders, without hash suffixes."""
    parts = [p for p in path.rstrip("/").split("/") if p and "=" not in p]
    if len(parts) >= 3 and re.fullmatch(r"dados_\d{4}\.csv", parts[-1]):  # flat layout: root/<product>/<file>
        parts = parts[:-2]
    name = parts[-1] if parts else path
    return re.sub(r"-[0-9a-f]{16,32}$", "", re.sub(r"\.parquet$", "", name))


def summarise(text: str) -> dict:
    scans = []
    for line in text.splitlines():
        if "FileScan" not in line:
            continue
        fmt = re.search(r"FileScan (\w+)", line).group(1)
        loc = re.search(r"\[(?:file|hdfs|s3a?|gs|abfss?):([^,\]]+)", line)
        pushed = bracketed(line, "PushedFilters")
        part = bracketed(line, "PartitionFilters")
        schema = re.search(r"ReadSchema: struct<([^>]*)>", line)
        scans.append({
            "table": table_name(loc.group(1)) if loc else "?",
            "format": fmt,
            "pushed": pushed or "",
            "partition": part or "",
            "columns": ",".join(c.split(":")[0] for c in schema.group(1).split(",")) if schema and schema.group(1) else "",
        })
    return {
        "scans": scans,
        "hash_exchanges": len(re.findall(r"Exchange hashpartitioning", text)),
        "range_exchanges": len(re.findall(r"Exchange rangepartitioning", text)),
        "single_partition": len(re.findall(r"Exchange SinglePartition", text)),
        "round_robin": len(re.findall(r"RoundRobinPartitioning", text)),
        "rebalance": len(re.findall(r"REBALANCE_PARTITIONS", text)),
        "broadcasts": len(re.findall(r"BroadcastExchange", text)),
        "smj": len(re.findall(r"SortMergeJoin", text)),
        "window_group_limit": len(re.findall(r"WindowGroupLimit", text)),
        "take_ordered": len(re.findall(r"TakeOrderedAndProject", text)),
        "python": len(re.findall(r"MapInPandas|PythonMapInArrow|MapInArrow", text)),
    }


def main(sf_dir: str, out: str) -> None:
    spark = build_session("local[8]", shuffle_partitions=16,
                          conf={"spark.sql.maxMetadataStringLength": "4000"})
    lines = ["# Physical plans of the catalog queries", "",
             f"Generated by `tools/plan_report.py` on `{sf_dir}` (final adaptive plans after a full run). "
             "Each query reads the ingested statement text (parquet, partitioned by product/year), the "
             "statement CSV files, the ingested customs rows, or `pages`. Exchanges: hash / range / single "
             "partition; `WGL` = WindowGroupLimit (partial+final), `TOP` = TakeOrderedAndProject, "
             "`BC` = broadcast exchanges, `SMJ` = sort-merge joins, `Py` = Arrow Python operator. The first two "
             "rows are the one-time ingest of the benchmark adapter (the joins, then the statement text; the "
             "text is then written partitioned by product and year). At sf0.1 every dimension side measures under "
             "the 10 MB broadcast threshold, so the planner broadcasts it; at scale those joins become sort-merge "
             "joins, and the line-item/order join is sort-merge at every size.", "",
             "| query | scans (table: pushed filters; partition filters; columns) | hash | range | single | BC | SMJ | WGL | TOP | Py |",
             "|---|---|---|---|---|---|---|---|---|---|"]
    from adega.sources import driver_tables as D
    jobs = {"ingest: cells (joins)": lambda sp, sf: D.raw_cells(sp, sf),
            "ingest: statement text": lambda sp, sf: D.statements_from_cells(D.cells_table(sp, sf))
            .hint("rebalance", "product", "year").sortWithinPartitions("product", "year", "country")}
    jobs.update(catalog.queries())
    for name, fn in jobs.items():
        s = summarise(final_plan(fn(spark, sf_dir)))
        scans = "<br>".join(
            f"{sc['table']} ({sc['format']}): {sc['pushed'] or '-'}; {sc['partition'] or '-'}; {sc['columns'] or '(none)'}"
            for sc in s["scans"])
        lines.append(f"| {name} | {scans} | {s['hash_exchanges']} | {s['range_exchanges']} | {s['single_partition']} | "
                     f"{s['broadcasts']} | {s['smj']} | {s['window_group_limit']} | {s['take_ordered']} | {s['python']} |")
        print(name, {k: v for k, v in s.items() if k != "scans"}, flush=True)
    with open(out, "w") as fh:
        fh.write("\n".join(lines) + "\n")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1", sys.argv[2] if len(sys.argv) > 2 else "PLANS.md")
