"""Awkward rows for every operator: nulls in any column, empty and very long texts, ties, repeated rows, columns whose names clash."""

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_lines long, score double, size long, node long, key string, h long, _q string, _tox string, _lang string, _id string, _base string, _spans string, _more string, row string, Kept string, Toxicity string"
PAGES = "page_id long, url string, html string, text string, key string, digest string, n long"


def words(n: int, tag: str = "w") -> str:
    return " ".join(f"{tag}{i}" for i in range(n))


def docs(spark: SparkSession) -> DataFrame:
    long_line = "Shared passage of some length here"
    rows = [
        (1, f"{long_line}\n{words(60)}", "en", "a"),
        (2, f"{long_line}\n{words(60, 'x')}", "en", "a"),
        (2, f"{long_line}\n{words(60, 'x')}", "en", "a"),
        (3, words(60), "en", "b"),
        (4, words(59) + " other", "fr", None),
        (5, None, None, "a"),
        (6, "", "en", ""),
        (7, " \n\t\r\n", "en", "b"),
        (None, words(60, "n"), "de", "b"),
        (None, None, None, None),
        (8, "one two", "de", "c"),
        (9, "ONE  TWO", "de", "c"),
        (10, words(30_000, "long"), "en", "a"),
        (11, "z" * 300_000, "en", "a"),
        (12, "12345 éÉ \U0001f600 mail me@a.example.com +1 (017) 555-7713", "fr", "b"),
    ]
    return spark.createDataFrame([(*r, None, 1, 0.5, 9, 9, "k", 1, *["mine"] * 10) for r in rows], DOCS)


def pages(spark: SparkSession) -> DataFrame:
    big = "<p>" + "Long enough text, with signs. " * 60 + "</p>"
    rows = [(1, "http://www.A.example.com/x?y", big), (2, "http://www.a.example.com/x?y", big), (3, None, big), (4, "odd", "<p>small"), (5, "http://b/", "<p>small"), (6, "http://b/", None), (7, "http://c\r\nd/", "a\r\n\r\nWARC/1.1\r\nb"), (None, "http://n/", "none"), (8, "http://l/", "<div>" * 5000 + "x"), (8, "http://l/", "<div>" * 5000 + "x")]
    return spark.createDataFrame([(*r, "t", "k", "d", 1) for r in rows], PAGES)
