"""Each query of the catalog against its SQL on the smallest tables."""

import os
import random

import duckdb
import pandas as pd
import pytest

from locusloom.plans import catalog, composites, tables  # noqa: F401  (the others add their queries)

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(float)
        elif len(df) and hasattr(df[c].iloc[0], "isoformat"):
            df[c] = pd.to_datetime(df[c]).dt.strftime("%F")
    return sorted(map(str, df.fillna("~").values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_align_map_takes_whole_sequences(spark, tmp_path):
    from locusloom.functions import alignment

    r = random.Random(4)
    ref = "".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(150))
    front, middle = ("".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n)) for n in (4, 40))
    texts = {0: "", 1: ref, 2: ref[:30], 3: front + ref, 4: ref[:70] + middle + ref[70:], 5: ref[:100] + ref[110:], 6: None, 7: ref[:20] + middle[:3] + ref[20:]}
    spark.createDataFrame(list(texts.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {}
    for x in catalog.QUERIES["align_map"](spark, str(tmp_path)).collect():
        got.setdefault(x.item_id, {})[x.query_pos] = x.label
    want = {}
    for i, q in texts.items():
        if not q:
            continue
        _, a, b = alignment.align(ref, q)
        labels, count, ha2 = [], -4, 0  # the next place of the reference; 5 letters of signal peptide end at 0
        for u, v in zip(a, b, strict=True):
            if u != "-" and v != "-":
                ha2 += count >= 40
                labels.append(f"HA2:{ha2}" if count >= 40 else f"SP{count}" if count < 1 else str(count))
            elif u == "-" and not labels:
                labels.append("N-term-Insert")
            elif u == "-":
                base = labels[-1]
                while base[-1:].isalpha() and base[-1:].isupper():
                    base = base[:-1]
                labels.append(base + chr(65 + len([k for k in labels if k.startswith(base) and k != base])))
            count += u != "-"
        want[i] = dict(enumerate(labels))
    assert got == want and {i: len(v) for i, v in got.items()} == {i: len(q) for i, q in texts.items() if q}
    assert got[1][0] == "SP-4" and got[1][149] == "HA2:106" and [got[3][k] for k in range(5)] == ["N-term-Insert", "N-term-InsertA", "N-term-InsertB", "N-term-InsertC", "SP-4"]
