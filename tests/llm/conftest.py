import pytest

from carepulse.llm.common import ship_package


@pytest.fixture(autouse=True, scope="session")
def shipped(spark):
    ship_package(spark)


#: Rows every text operator must take: nulls, empty, no letters, long, repeated, a shared id.
EDGE = [
    (1, None, "en"),
    (2, "", "en"),
    (3, "  \n\t ", None),
    (4, "12 %% 34", "en"),
    (5, "the cat sat on the mat and looked at the dog", "en"),
    (5, "the cat sat on the mat and looked at the dog", "en"),
    (None, "a row without an id, with some words in it", None),
    (7, "word " * 30_000, "en"),
    (8, "x" * 50_000, "en"),
    (8, "another text under the same id", "de"),
]
EDGE_SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture()
def edge_docs(spark):
    """The edge rows with further columns whose names operators use themselves."""
    rows = [(*r, 1, "s", 0.5, 1, 2) for r in EDGE]
    return spark.createDataFrame(rows, f"{EDGE_SCHEMA}, n int, source string, score double, fp int, `__id` int")


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)
