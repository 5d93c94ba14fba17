"""Developer check: run queries and their oracle SQL side by side and compare types and values.

    python tests/oracle_check.py /root/testdata/sf0.01 [name ...]
"""

import collections
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from clipline.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


SQL_KINDS = {"BIGINT": "int64", "INTEGER": "int32", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "bool", "TIMESTAMP": "timestamp", "VARCHAR[]": "list<element: string>", "BIGINT[]": "list<element: int64>", "DOUBLE[]": "list<element: double>", "FLOAT": "float", "DATE": "date32[day]"}


def plain(v):
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows(table, names):
    cols = [table.column(n).to_pylist() for n in names]
    return collections.Counter(tuple(plain(v) for v in r) for r in zip(*cols)) if names else collections.Counter()


def kind(t):
    t = str(t).replace("large_", "").replace("string_view", "string").replace(" not null", "")
    return "timestamp" if t.startswith("timestamp") else t


def main():
    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session("8", "oracle-check")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = []
    for name in wanted or list(qs):
        t0 = time.time()
        try:
            got = qs[name](spark, folder).toArrow()
        except Exception as e:  # noqa: BLE001
            print(f"{name}: SPARK ERROR {str(e)[:1500]}")
            bad.append(name)
            continue
        t1 = time.time()
        if name not in sqls:
            print(f"{name}: rows only n={got.num_rows} spark={t1 - t0:.1f}s {got.schema.names}")
            continue
        try:
            types = {r[0]: SQL_KINDS.get(r[1], r[1].lower()) for r in con.execute(f"DESCRIBE {sqls[name]}").fetchall()}
            want = con.execute(sqls[name]).fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{name}: ORACLE ERROR {str(e)[:800]}")
            bad.append(name)
            continue
        t2 = time.time()
        names = sorted(got.schema.names)
        if names != sorted(types):
            print(f"{name}: COLUMNS {names} vs {sorted(types)}")
            bad.append(name)
            continue
        off = [(n, kind(got.schema.field(n).type), types[n]) for n in names if kind(got.schema.field(n).type) != types[n]]
        place = [list(types).index(n) for n in names]
        a, b = rows(got, names), collections.Counter(tuple(plain(r[i]) for i in place) for r in want)
        ok = a == b
        print(f"{name}: {'ok' if ok and not off else 'MISMATCH'} n={got.num_rows}/{len(want)} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s {off or ''}")
        if not ok or off:
            bad.append(name)
            print("   names", names)
            for r in sorted((a - b).items(), key=str)[:4]:
                print("   spark only", str(r)[:400])
            for r in sorted((b - a).items(), key=str)[:4]:
                print("   duck only ", str(r)[:400])
    print("FAILED:", bad)
    spark.stop()


main()
