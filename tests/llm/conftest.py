import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

P1 = "The quick brown fox jumps over the lazy dog, and then it runs away; nobody saw it again. "
LONG = " ".join(f"word{i} other{i % 89}" for i in range(20000))
EDGE = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n ", None, None, 4), (4, "one", "en", "b", 3),
    (5, "one", "en", "b", 3), (6, "ONE", "en", "b", 3), (7, P1 * 4, "en", "c", 1), (8, P1 * 4, "en", "c", 1),
    (9, (P1 * 4).upper(), "en", None, 1), (10, "x " + P1 * 4, "en", "c", 1), (11, LONG, "en", "big", 1),
    (12, LONG + " tail", "en", "big", 1), (13, "é" * 500, "fr", "a", 500), (14, "a" * 3000, "en", "a", 3000),
    (15, "\n".join(["same line here"] * 60), "en", "a", 1), (15, "\n".join(["same line here"] * 60), "en", "a", 1),
    (None, "no id " + P1, "en", "d", 1), (17, "<|endoftext|> a <|endoftext|>", "en", "d", 1), (18, "日本語 テキスト。🙂" * 30, "ja", "d", 1),
    (-3, "A negative id, and some words of its own that nobody else here has said before; not even once.", "en", "d", 1),
]


@pytest.fixture(scope="session")
def spark():
    from tablecraft.session import local_session
    yield local_session("4", shuffle_partitions=4, app="tablecraft-tests")


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
