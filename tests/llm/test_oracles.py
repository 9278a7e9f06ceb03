"""Queries with DuckDB SQL, on the smallest tables and on the edge rows."""
import duckdb
import pyarrow as pa
import pytest

from .conftest import EDGE, SF

pytestmark = pytest.mark.filterwarnings("ignore")


def digest(table):
    from tools.check_oracle import table_digest
    return table_digest(table)


def names():
    from tablecraft.llm.queries import ORACLE_SQL
    return sorted(ORACLE_SQL)


@pytest.mark.parametrize("name", names())
def test_query_matches_sql(spark, name):
    from tablecraft.llm.queries import ORACLE_SQL, QUERIES
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[name](spark, SF).toArrow(), con.execute(ORACLE_SQL[name]).to_arrow_table()
    assert got.num_rows == want.num_rows and sorted(got.column_names) == sorted(want.column_names)
    assert digest(got) == digest(want)


@pytest.fixture(scope="module")
def edge_dir(spark, tmp_path_factory):
    import pyarrow.parquet as pq
    d = tmp_path_factory.mktemp("edge")
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    # rows with an id of their own: the SQL knows rows by id
    rows = [r for k, r in enumerate(EDGE) if r[0] is not None and r not in EDGE[:k]]
    pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema), d / "documents.parquet")
    turns = [(1, 0, "user", None), (1, 1, "assistant", "a <|im_end|>\n <\\| </s> [\\/INST]"), (1, 2, "user", "tail"), (2, 0, "system", ""),
             (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (3, None, "user", "first"), (4, 5, None, "no role"), (4, 6, "assistant", None)] \
        + [(5, k, ("user", "assistant")[k % 2], f"turn {k} é🙂") for k in range(150)]
    pq.write_table(pa.table({c: [t[k] for t in turns] for k, c in enumerate(("conv_id", "turn", "role", "text"))}), d / "conversations.parquet")
    return str(d)


@pytest.mark.parametrize("name", names())
def test_edge_rows_match_sql(spark, edge_dir, name):
    from tablecraft.llm.queries import ORACLE_SQL, QUERIES
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{edge_dir}/{t}.parquet')")
    got, want = QUERIES[name](spark, edge_dir).toArrow(), con.execute(ORACLE_SQL[name]).to_arrow_table()
    assert digest(got) == digest(want)
