import pytest

DATA = "/root/testdata/sf0.001"
#: Texts that operators meet at their edges.
EDGES = [None, "", " ", "\n\n", "a", "à b", "word " * 3, "x" * 5000, "the ▁ sign", "<|endoftext|> end<|endoftext|>", "  two  spaces ", "tab\tand\r\nline", "  nbsp 　wide", "漢字かな交じり文", "é" * 70000, "MOSTLY CAPITALS HERE", "emoji 👩‍👩‍👧 zwj", "\x00\x1c ctl", "'re 's 'll!'s"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Edge texts, each twice over two ids, a repeated row, null ids and sources, and columns with names that operators use."""
    rows = [(i if i != 4 else None, t, "en", "s" if i % 3 else None, 0, 1.5, "x", True) for i, t in enumerate([*EDGES, *EDGES])]
    rows.append(rows[6])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, fingerprint string, kept boolean")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet").cache()


@pytest.fixture
def empty(edge_docs):
    return edge_docs.where("false")
