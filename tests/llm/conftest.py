import datetime
import random

import pytest

WORDS = "the of and stone river candle morning window idiot paper garden silver market ocean letter winter bridge".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) * (r.random() < 0.3) for _ in range(n))


@pytest.fixture(scope="session")
def corner_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, copies; extra columns with clashing names."""
    day = datetime.datetime(2024, 1, 1)
    base = prose(1, 120)
    texts = [
        (1, "Mit License here\nsecond line of it\n\n---\nsecond  LINE of it!", "en", "a"), (2, None, "fr", "a"), (3, "", None, None), (4, "   \n\t ", "de", "b"),
        (5, base, "en", "b"), (6, base, "en", "b"), (6, base, "en", "b"), (7, base + " tail", "en", None), (None, "a text without id", "en", "a"), (8, prose(2, 9000), "es", "a"),
        (9, "Ünïcode ümlaut 中文 идиот 1d1ot <|endoftext|> x", "de", "ü"), (10, "12345 !!! 678", "en", "b"), (11, "one", "en", "c"), (12, "gnu general public license gnu general public license", "en", "c"),
    ]
    return [(i, t, lang, src, None if t is None else len(t), 0.5, "x", 7, day, 1, "y") for i, t, lang, src in texts]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, root string, copies int, fp timestamp, __score int, n_lines string"


@pytest.fixture(scope="session")
def corners(spark, corner_rows):
    return spark.createDataFrame(corner_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, None if i == 4 else int(i in (9, 11))) for i in range(1, 13)] + [(None, 0, 1)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def corner_dir(tmp_path_factory, corners, labels):
    d = tmp_path_factory.mktemp("corners")
    corners.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory, empty, labels):
    d = tmp_path_factory.mktemp("nothing")
    empty.write.parquet(f"{d}/documents.parquet")
    labels.limit(0).write.parquet(f"{d}/labels.parquet")
    return str(d)


@pytest.fixture(scope="session")
def sample_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
