"""Language identification: odd pages, and a column of too many languages."""

import pytest

from lacuna.llm import language_id

DOCS = [(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog went with them there", "en"), ("der hund und die katze sind nicht hier gewesen", "de")] * 5)]
PAGES = "page_id long, url string, html string, lang string, posterior double, host long, c string"


def found(spark, pages):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    return language_id.identify(spark.createDataFrame([(*p, "x", 0.5, 7, "c") for p in pages], PAGES), docs).collect()


def test_odd_pages(spark):
    english, german = "<p>the dog with the cat</p>", "<html lang=DE><p>die katze und der hund</p>"
    pages = [(1, "http://a.com/", english), (1, "http://a.com/", english), (2, "http://b.de/", german), (None, "http://b.de/", german), (3, None, None), (4, "", ""), (5, "no address", "<p>" + "the dog and the cat " * 60_000), (6, "http://a.com/x", "<p>xyz"), (7, "http://[::1]:80/", "<!-- the the --> <script>der die das</script>")]
    rows = found(spark, pages)
    assert len(rows) == len(pages)
    by_id = {r.page_id: r for r in rows}
    assert by_id[1].lang == by_id[5].lang == by_id[6].prior_lang == "en" and by_id[2].lang == by_id[None].lang == "de"
    assert by_id[2].declared == "de" and by_id[5].text_lang == "en"
    assert by_id[3].text_lang == by_id[4].text_lang == by_id[7].text_lang == "de"  # flat: the first in order
    assert sorted(r.confidence for r in rows if r.page_id == 1)[0] == max(r.confidence for r in rows if r.page_id == 1)
    assert all(0 < r.confidence <= 1 for r in rows)
    assert found(spark, []) == []


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError, match="more than 1 languages"):
        found(spark, [(1, "http://a.com/", "x")])
