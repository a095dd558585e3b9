"""The queries of the training-data operators against their SQL."""

import random
import string

import duckdb
import pandas as pd
import pytest

from leafmark.llm import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def alike(spark, name, folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want, got = con.execute(Q.ORACLE[name]).fetchdf(), Q.queries()[name](spark, folder).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = lambda f: sorted((tuple(None if pd.isna(x) else x for x in r) for r in f[columns].astype(object).values.tolist()), key=str)
    assert rows(want) == rows(got)
    return want


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_same_as_sql(spark, name):
    assert len(alike(spark, name, SF, TABLES))


def test_battery_same_as_sql(spark, tmp_path):
    """Random tokens of all encodings and lengths among words, paths, repeated letters and base matches."""
    r, letters = random.Random(5), string.ascii_letters + string.digits
    pick = lambda alphabet, *sizes: "".join(r.choice(alphabet) for _ in range(r.choice(sizes)))
    plain = ("alpha", "path/to/some-long-file_name/of_things", "camelCaseIdentifierNameThatIsLong", "a" * 28, "1234567890" * 3)
    make = (
        lambda: "é" + r.choice(plain), lambda: pick(letters + "+/", 24, 32, 40, 64, 90, 200), lambda: f'Secret = "{pick(letters, 14)}"', lambda: pick("0123456789abcdef", 12, 16, 32, 64),
        lambda: "AKIA" + pick(string.ascii_uppercase + "234567", 5, 16, 40), lambda: pick(letters, 19, 20, 33) + "_x", lambda: "\n",
    )
    rows = [(i if i % 19 else None, " ".join(r.choice(make)() for _ in range(r.randint(0, 12))) if i % 17 else None) for i in range(300)]
    frame = pd.DataFrame(rows + rows[:9], columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    frame.to_parquet(tmp_path / "documents.parquet")
    want = alike(spark, "op7_secret_scan", str(tmp_path), ["documents"])
    assert want["spans"].str.contains("random").sum() > 100
    frame[:0].to_parquet(tmp_path / "documents.parquet")
    assert len(alike(spark, "op7_secret_scan", str(tmp_path), ["documents"])) == 0
