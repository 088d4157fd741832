"""Compare every registered query with its SQL counterpart: ``python tests/check_oracle.py [sf] [names…]``."""

import sys
import time
from pathlib import Path

import duckdb
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(table: pa.Table) -> tuple[list, list]:
    names = sorted(table.column_names)
    types = [(n, str(table.schema.field(n).type).replace("large_string", "string").replace("string_view", "string")) for n in names]
    columns = [table.column(n).to_pylist() for n in names]
    return types, sorted(zip(*columns), key=repr) if columns else []


def compare(spark, con, name, query, oracle, sf_dir) -> str | None:
    got = normal(query(spark, sf_dir).toArrow())
    want = normal(con.sql(oracle).to_arrow_table())
    if got[0] != want[0]:
        return f"schema {[p for p in zip(got[0], want[0]) if p[0] != p[1]] or (got[0], want[0])}"
    if got[1] != want[1]:
        ours, theirs = set(got[1]), set(want[1])
        only = sorted(ours - theirs, key=repr)[:2], sorted(theirs - ours, key=repr)[:2]
        return f"rows {len(got[1])} / {len(want[1])}, e.g. {only}"
    return None if got[1] else "empty"


def main() -> int:
    import __spark_entry__ as entry
    from shelfwise.session import build_session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    wanted = sys.argv[2:]
    spark = build_session(
        "check", "local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false", spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        oracle = entry.oracle_sql().get(name)
        started = time.time()
        try:
            problem = compare(spark, con, name, query, oracle, sf_dir) if oracle else "no SQL"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - started:.1f}s {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
