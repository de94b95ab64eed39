"""Print the key physical-plan lines of the main building blocks.

usage: python tools/plans.py [sf_dir]  (writes nothing; prints Markdown)
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.operators.rank import with_pct_ranks  # noqa: E402
from tidemark.session import get_spark  # noqa: E402
from tidemark.sources import fixtures as FXT  # noqa: E402

KEEP = re.compile(r"(Scan parquet|ReadSchema|PushedFilters|Exchange|HashAggregate|Join|Window|"
                  r"Generate|Bucketizer|TakeOrdered|LogicalRDD|Scan ExistingRDD)")


def show(title: str, df) -> None:
    plan = df._jdf.queryExecution().executedPlan().toString()
    print(f"### {title}\n\n```")
    for line in plan.splitlines():
        if KEEP.search(line):
            print(re.sub(r"#\d+L?", "", line)[:220])
    print("```\n")


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark("local[8]", shuffle_partitions=16)
    show("churn_input: orders pre-aggregated per customer, then joined", FXT.churn_input(spark, sf))
    show("events_input: events aggregated per user", FXT.events_input(spark, sf))
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    show("percentile ranks (W1) for lineitem.l_extendedprice", with_pct_ranks(li, ["l_extendedprice"]))
    spark.stop()


if __name__ == "__main__":
    main()
