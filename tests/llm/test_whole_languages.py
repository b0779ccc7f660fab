"""Languages that a sample over all rows, or of short rows only, would miss."""

from lacuna.llm import language_id
from lacuna.llm.language_id import LANGUAGE_ROWS, fit_text, identify, sample

EN, RARE, LONG = "the cat sat on the mat and looked ", "zyxu wvuq qpuz xyyw ", "oomi kaari luusa peeko "
SCHEMA = "doc_id long, text string, lang string"


def corpus(spark):
    common = spark.range(12_000).selectExpr("id AS doc_id", f"concat('{EN}', id % 7) AS text", "'en' AS lang")
    few = [(20_000, RARE * 20, "ra"), (20_001, LONG * 2000, "lo"), (20_002, None, "no"), (20_003, "x", None)]
    return common.union(spark.createDataFrame(few, SCHEMA))


def test_rare_and_long_languages_are_known(spark):
    docs = corpus(spark)
    languages, taken = sample(docs, "doc_id", "text", "lang")
    assert sorted(languages) == ["en", "lo", "ra"]
    assert {r.lang: r["count"] for r in taken.groupBy("lang").count().collect()} == {"en": LANGUAGE_ROWS, "lo": 1, "ra": 1}
    pages = [(k, f"http://h{k}.{s}/", f"<html lang='{s}'><body>{t * 5}</body></html>") for k, (s, t) in enumerate([("en", EN), ("ra", RARE), ("lo", LONG)] * 6)]
    got = identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs)
    assert all(r.lang == r.declared for r in got.collect())


def test_whole_texts_are_counted(spark):
    text = LONG * 2000 + "qqq"
    model = fit_text(spark.createDataFrame([(1, text, "lo"), (2, EN, "en")], SCHEMA))
    rare = language_id.trigram_counts("qqq")[1]
    assert model.languages == ["en", "lo"]
    assert model.logs[1, rare] > model.logs[1].min()


def test_rows_of_one_id_or_none_are_taken(spark):
    one = spark.range(9000).selectExpr("CAST(7 AS BIGINT) AS doc_id", f"'{EN}' AS text", "'en' AS lang")
    none = spark.range(9000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", f"'{RARE}' AS text", "'ra' AS lang")
    taken = sample(one.union(none), "doc_id", "text", "lang")[1]
    assert {r.lang: r["count"] for r in taken.groupBy("lang").count().collect()} == {"en": LANGUAGE_ROWS, "ra": LANGUAGE_ROWS}
