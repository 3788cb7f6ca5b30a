import itertools
import os

import pytest


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Writes rows as the tables of a data folder: ``folder(documents=(ddl, rows), ...)``."""
    top = tmp_path_factory.mktemp("tables")
    numbers = itertools.count()

    def write(**tables):
        path = os.path.join(top, str(next(numbers)))
        for name, (ddl, rows) in tables.items():
            spark.createDataFrame(rows, ddl).write.parquet(f"{path}/{name}.parquet")
        return path

    return write


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents():
    """(ddl, rows) of a documents table from texts, with clashing extra columns on request."""
    def make(texts, langs=None, sources=None, ids=None, extra=()):
        ids = ids if ids is not None else range(len(texts))
        langs, sources = langs or [None] * len(texts), sources or ["s"] * len(texts)
        rows = [(i, t, g, s, None if t is None else len(t), *["x" for _ in extra]) for i, t, g, s in zip(ids, texts, langs, sources)]
        return DOCS + "".join(f", {c} string" for c in extra), rows

    return make
