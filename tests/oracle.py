"""Run the named queries in Spark and their SQL in DuckDB and compare.

    python tests/oracle.py [sf directory] [query ...]
"""

import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
KINDS = {"long": "bigint", "integer": "int", "varchar": "string", "timestamp_ntz": "timestamp",
         "boolean": "bool", "hugeint": "hugeint"}


def connect(sf):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    return con


def _kind(name):
    name = str(name).lower()
    return {"integer": "int", "varchar": "string", "timestamp_ntz": "timestamp",
            "boolean": "bool"}.get(name, name)


def _plain(value):
    return float(value) if isinstance(value, Decimal) else value


def _sortable(row):
    return [(v is None, str(type(v)) if v is None else "", repr(v)) for v in row]


#: Value columns that hold nothing on purpose; any other tells nothing by agreeing.
#: A strict statistic of a channel with gaps is missing; o3 beside it has none.
BLANK = {"parse_instants": {"bad"}, "so2_diagnostics": {"conv_temp"},
         "station_mean_strict": {"no"}, "group_sd_strict": {"no"}}


def compare(df, con, sql, blank=None):
    """None when both agree, else what differs; ``blank`` names the columns that may be all NULL."""
    names = sorted(df.columns)
    kinds = {c: _kind(t) for c, t in df.dtypes}
    have = sorted((tuple(_plain(v) for v in r) for r in df.select(*names).collect()), key=_sortable)
    described = con.execute(f"describe {sql}").fetchall()
    theirs = {r[0]: _kind(r[1]) for r in described}
    if sorted(theirs) != names:
        return f"columns {names} and {sorted(theirs)}"
    if theirs != kinds:
        return f"types {[(c, kinds[c], theirs[c]) for c in names if kinds[c] != theirs[c]]}"
    chosen = ", ".join(f'"{n}"' for n in names)
    want = con.execute(f"select {chosen} from ({sql}) q").fetchall()
    want = sorted((tuple(_plain(v) for v in r) for r in want), key=_sortable)
    if len(have) != len(want):
        return f"rows {len(have)} and {len(want)}"
    if blank is not None and have:
        empty = {n for i, n in enumerate(names) if all(r[i] is None for r in have)} - set(blank)
        if empty:
            return f"nothing but NULL in {sorted(empty)}"
    bad = [(h, w) for h, w in zip(have, want) if h != w]
    return f"{len(bad)} of {len(have)} rows, first {names} {bad[0]}" if bad else None


def main():
    from driftline.session import build_session
    from __spark_entry__ import oracle_sql, queries
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or [n for n in queries() if n in oracle_sql()]
    spark = build_session("oracle", master="local[8]", shuffle_partitions=8,
                          **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, wrong = connect(sf), 0
    for name in chosen:
        began = time.time()
        try:
            problem = compare(queries()[name](spark, sf), con, oracle_sql()[name],
                              BLANK.get(name, ()))
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        wrong += problem is not None
        print(f"{name:40s} {time.time() - began:6.1f}s  {problem or 'ok'}", flush=True)
    print(f"{len(chosen) - wrong} of {len(chosen)} agree")
    return wrong


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
