"""Small tables with the awkward cases: nulls, empty and long texts, repeated rows, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, ids string, row string, _key long"


def awkward_texts() -> list[tuple[int | None, str | None]]:
    rnd = random.Random(11)
    words = ["the", "of", "and"] + ["w%d" % i for i in range(300)]

    def prose(n: int) -> str:
        return " ".join(rnd.choice(words) for _ in range(n))

    shared, long = prose(60), prose(30_000)
    out: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One two"), (6, shared), (7, shared), (7, shared),
        (8, prose(20) + "\n" + shared + "  " + prose(20)), (8, prose(25)), (None, shared), (None, None), (9, long),
        (10, long + " end"), (11, "mail a.b@c.example.org or +1 (555) 010-9999, 10.0.0.1 and 4111 1111 1111 1111 now"),
        (12, "Ünïcode straße 日本語 😀 𝔘 é́ <|endoftext|> ﬁn İI"), (13, prose(12)), (14, "x" * 20_000)]
    out += [(100 + i, prose(rnd.randint(1, 80))) for i in range(40)]
    return out


def docs_of(spark: SparkSession, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    return spark.createDataFrame([(d, t, None, "s", len(t or ""), 5, "x", "y", 6) for d, t in rows], SCHEMA).repartition(3)


def awkward(spark: SparkSession) -> DataFrame:
    return docs_of(spark, awkward_texts())


def empty(spark: SparkSession) -> DataFrame:
    return docs_of(spark, [])
