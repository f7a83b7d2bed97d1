"""List column-type differences between each query and its DuckDB oracle."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from vigil.plans import load_all  # noqa: E402
from vigil.session import get_spark  # noqa: E402
from vigil.sources.tables import TABLES  # noqa: E402

SPARK2DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
              "date": "DATE", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT", "timestamp": "TIMESTAMP WITH TIME ZONE",
              "timestamp_ntz": "TIMESTAMP"}

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
q, o = load_all()
spark = get_spark()
con = duckdb.connect()
for t in TABLES:
    con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
for k in sorted(o):
    df = q[k](spark, sf)
    st = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rel = con.sql(o[k])
    dt = dict(zip(rel.columns, [str(x) for x in rel.types]))
    bad = [(c, st[c], dt.get(c)) for c in st if SPARK2DUCK.get(st[c], st[c]) != dt.get(c)]
    if bad:
        print(k, bad)
