"""The SQL of operators 1, 4 and 8 against their queries, on the tables and on odd rows."""

import duckdb
import pytest

from skeinframe.llm import queries

SF = "/root/testdata/sf0.001"


def rows_by_sql(relation: str) -> tuple[list, list]:
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM {relation}")
        got = con.execute(queries.ORACLE["op4_line_rules"])
        names = [c[0] for c in got.description]
        return names, sorted(got.fetchall(), key=str)


@pytest.mark.parametrize("odd", [False, True])
def test_line_rules_sql(spark, tmp_path, odd):
    folder = SF
    if odd:
        folder = str(tmp_path)
        texts = [None, "", " \n ", "a b c d e. " * 20, "a b c d e. " * 20, "é\u0085x ü! »" * 12, "one two three four five six seven eight nine ten eleven.\nSkip To Content here.", "| a | b | c d e f g h i j k.\nok one.\nok one.", "x " * 9 + "x."]
        spark.createDataFrame([(i // 2, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, n_words string").write.parquet(f"{folder}/documents.parquet")
        relation = f"'{folder}/documents.parquet/*.parquet'"
    else:
        relation = f"'{folder}/documents.parquet'"
    names, expected = rows_by_sql(relation)
    out = queries.op4_line_rules(spark, folder)
    assert sorted(out.columns) == sorted(names)
    assert sorted((tuple(r) for r in out.select(*names).collect()), key=str) == expected


@pytest.mark.parametrize("name", ["op1_warc_zip", "op8_hyperminhash"])
@pytest.mark.parametrize("odd", [False, True])
def test_other_sql(spark, tmp_path, name, odd):
    table = "pages" if name == "op1_warc_zip" else "documents"
    folder = SF
    if odd:
        folder = str(tmp_path)
        long = [f"Word{i}" for i in range(70)]
        texts = [None, "", "<p>é </p>", "same", "same", "SAME", " ".join(long), " ".join(long).lower(), " ".join([*long[:40], "x", *long[41:]]), " ".join(long[:30]), "a b", "A  B", None]
        columns = "page_id long, url string, html string, n string" if table == "pages" else "doc_id long, text string, rid string, key string"
        rows = [(i, "http://a/{x}", t, "n") if table == "pages" else (i, t, "r", "k") for i, t in enumerate(texts)]
        spark.createDataFrame(rows, columns).write.parquet(f"{folder}/{table}.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet{'/*.parquet' if odd else ''}'")
        got = con.execute(queries.ORACLE[name])
        names, expected = [c[0] for c in got.description], sorted(got.fetchall(), key=str)
    out = queries.queries()[name](spark, folder)
    assert sorted(out.columns) == sorted(names)
    assert sorted((tuple(r) for r in out.select(*names).collect()), key=str) == expected
