import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, uid int, part int, bucket int, ids string, score string, at string"


def words(rnd, n):
    return [rnd.choice("the of and kin ro ble tion ster ou an re ti hea nd er".split()) + rnd.choice("a e i o u ing ed ly".split()) + str(rnd.randint(0, 9) or "") for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Copies, near copies, shared passages, repeated rows and ids, nulls, empty and very long texts."""
    rnd = random.Random(11)
    passage = " ".join(words(rnd, 40))
    text = " ".join(words(rnd, 120))
    near = text.replace(text.split(" ")[60], "changed", 1)
    loop = "again and " * 60
    texts = [(i, " ".join(words(rnd, rnd.randint(1, 80)))) for i in range(30, 60)]
    texts += [(1, text), (2, text), (2, text), (3, near), (2, f"{passage} other text of id two"), (4, f"start\t{passage}\nend"), (5, f"{passage[:100]} cut"), (None, f"no id {passage}"), (None, None), (6, None), (7, ""), (8, " \t\n "), (9, loop), (10, loop + "x"), (11, "Ünï cödé 💩 " + passage + " ▁ end"), (12, "\0\x01 zero " + passage), (13, "a"), (14, "A b C"), (15, "a B c"), (16, " ".join(words(rnd, 30_000)) + passage), (17, "x" * 5000)]
    return [(i, t, "en" if n % 3 else None, f"s{n % 4}" if n % 5 else None, None if t is None else len(t), n, n, n, n, "ids", "s", None) for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
