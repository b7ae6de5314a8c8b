import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T


def one(spark, expr, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "code"), [
    ("the cat and the dog", "en"), ("der Hund und die Katze ist nicht", "de"), ("これはペンです", "ja"), ("这是一本书", "zh"),
    ("이것은 책입니다", "ko"), ("это книга", "ru"), ("12345", "unknown"), ("", "unknown"), (None, "unknown"),
])
def test_language(spark, text, code):
    assert one(spark, T.detect_language(F.col("t").cast("string")), t=text)["code"] == code


def test_language_of_the_whole_text(spark):
    text = F.concat(F.repeat(F.lit("the cat and the dog "), 10_500), F.repeat(F.lit("это книга "), 60_000))
    assert one(spark, T.detect_language(text))["code"] == "ru"
    assert one(spark, T.detect_language(text, sample=200_000))["code"] == "en"
    words = F.concat(F.repeat(F.lit("the cat and the dog "), 10_500), F.repeat(F.lit("der Hund und die Katze "), 30_000))
    assert one(spark, T.detect_language(words))["code"] == "de"


def test_language_confidence(spark):
    got = one(spark, T.detect_language(F.col("t")), t="the the the la")
    assert (got["code"], got["confidence"], got["scripts"]) == ("en", 0.8, {"latin": 1.0})


@pytest.mark.parametrize(("text", "lang", "out"), [
    ("exam-\nple and\r\nmore\rhere", "en", "example and more here"),
    ("One.\n\nlower paragraph stays", "en", "One.\n\nlower paragraph stays"),
    ("end\n\nlower", "en", "end\n\nlower"),
    ("a\n- 12 -\nB", "en", "a\nB"), ("so­ft \t x\n\n\n\ny", "en", "soft x\n\ny"),
    ("你好，\n世界", "zh", "你好,世界"), ("ＡＢ１", "en", "AB1"),
])
def test_clean_text(spark, text, lang, out):
    assert one(spark, T.clean_text(F.col("t"), F.col("l")), t=text, l=lang) == out


def test_clean_for_speech(spark):
    raw = "# Hi **bold** and *it* `c` ~~no~~ [link](u) (laughs) [BGM x]\n> quote"
    assert one(spark, T.clean_for_speech(F.col("t")), t=raw) == "Hi bold and it c no link … quote"


def test_sentences(spark):
    assert one(spark, T.split_sentences(F.col("t")), t="A b. C d! e? 你好。再见") == ["A b.", "C d!", "e?", "你好。", "再见"]
    assert one(spark, T.split_sentences(F.col("t")), t=" ") == [" "]


@pytest.mark.parametrize(("s", "n"), [("十", 10), ("十二", 12), ("二十", 20), ("二百零三", 203), ("九", 9), ("一百二十", 120)])
def test_chinese_number(spark, s, n):
    assert one(spark, T.chinese_number(F.col("s")), s=s) == n


def test_small_functions(spark):
    assert one(spark, T.title_key(F.col("t")), t="《产品的视角》：从 热闹-到门道") == "产品的视角从热闹到门道"
    assert one(spark, T.title_key(F.col("t").cast("string")), t=None) == ""
    assert one(spark, T.clock_text(F.col("t")), t=3725.9) == "1:02:05"
    assert one(spark, T.clock_text(F.col("t")), t=65.0) == "1:05"
    assert one(spark, T.safe_name(F.col("t")), t='a/b:*c"') == "a b c"
    assert [one(spark, T.episode_id(F.col("t")), t=t) for t in ("3", "03", "100", "123", " EP7 ", "1000")] == ["ep03", "ep03", "ep100", "ep123", "ep7", "ep1000"]
    assert one(spark, T.score_of(F.col("t")), t=876) == 87.6
    assert one(spark, T.score_of(F.col("t")), t=0) is None
    assert one(spark, T.markdown_title(F.col("t"), F.lit("stem")), t="x\n# Title \ny") == "Title"
    assert one(spark, T.markdown_title(F.col("t").cast("string"), F.lit("stem")), t=None) == "stem"
    import hashlib

    assert one(spark, T.segment_hash(F.lit("edge"), F.lit("v"), F.col("t")), t="hi") == hashlib.sha1(b"edge|v|{}|hi").hexdigest()[:12]
