"""Text functions: column expressions wherever built-ins suffice, Arrow-batched UDFs where they don't."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code point ranges of the scripts that are told apart.
SCRIPTS = {
    "han": r"一-鿿㐀-䶿豈-﫿",
    "kana": r"぀-ゟ゠-ヿ",
    "hangul": r"가-힯ᄀ-ᇿ㄰-㆏",
    "cyrillic": r"Ѐ-ӿ",
    "arabic": r"؀-ۿݐ-ݿ",
    "hebrew": r"֐-׿",
    "devanagari": r"ऀ-ॿ",
    "thai": r"฀-๿",
    "greek": r"Ͱ-Ͽ",
    "latin": r"A-Za-zÀ-ɏ",
}
# Frequent function words by language, in the order that settles ties.
STOPWORDS = {
    "en": "the and of to in that is it for with as was on are this",
    "es": "de la que el en y los se del las un por con para una",
    "fr": "de la le et les des en un du une que dans qui pour pas",
    "de": "der die und den das von mit ist des dem nicht ein eine auch sich",
    "pt": "de que os as do da em um para com não uma por dos das",
    "it": "di che il la e per un in non una con del da sono le",
    "nl": "de het een van en in is dat op te met voor niet zijn aan",
    "id": "yang dan di itu dengan untuk tidak ini dari dalam akan pada adalah",
    "vi": "của và là có được trong cho không một người những với để",
    "tr": "bir ve bu için ile de da çok olarak daha ama gibi kadar",
}
# Names of the languages.
LANGUAGE_NAMES = {
    "zh": "中文", "ja": "日本語", "ko": "한국어", "ru": "Русский", "ar": "العربية", "he": "עברית", "hi": "हिन्दी",
    "th": "ไทย", "el": "Ελληνικά", "en": "English", "es": "Español", "fr": "Français", "de": "Deutsch",
    "pt": "Português", "it": "Italiano", "nl": "Nederlands", "id": "Bahasa Indonesia", "vi": "Tiếng Việt", "tr": "Türkçe",
}
# Script, its language, the least share, and how confidence follows from the share.
BY_SCRIPT = [
    ("kana", "ja", 0.02, 6, 0.4),
    ("hangul", "ko", 0.15, 1, 0.3),
    ("han", "zh", 0.15, 1, 0.3),
    ("cyrillic", "ru", 0.3, 1, 0.2),
    ("arabic", "ar", 0.3, 1, 0.2),
    ("hebrew", "he", 0.3, 1, 0.2),
    ("devanagari", "hi", 0.3, 1, 0.2),
    ("thai", "th", 0.3, 1, 0.2),
    ("greek", "el", 0.3, 1, 0.2),
]
UNSPACED = ("zh", "ja", "ko", "th")


def blank_to_null(c: Column) -> Column:
    """Missing means null or blank."""
    return F.when(F.trim(c) != "", c)


def first_present(*columns: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in columns])


def let(value: Column, then) -> Column:
    """then(value), with value computed once per row however often it is used."""
    return F.transform(F.array(value), lambda x: then(x))[0]


#: Of each function word, the places of the languages that it votes for.
_VOTES = {w: [k for k, own in enumerate(STOPWORDS.values()) if w in own.split()] for words in STOPWORDS.values() for w in words.split()}
_SCRIPTS = [re.compile(f"[{r}]") for r in SCRIPTS.values()]
_WORDS = re.compile("[a-zà-öø-ÿ]+")
SIGNS = T.StructType([T.StructField("scripts", T.ArrayType(T.LongType())), T.StructField("votes", T.ArrayType(T.LongType()))])


@F.pandas_udf(SIGNS)
def language_signs(texts: pd.Series) -> pd.DataFrame:
    """How many characters of each script a text has, and function words of each language: one pass over characters and words."""
    scripts, votes = [], []
    for text in texts:
        text = text or ""
        by_script, by_language = [0] * len(_SCRIPTS), [0] * len(STOPWORDS)
        for c, n in Counter(text).items():
            for k, pattern in enumerate(_SCRIPTS):
                if pattern.match(c):
                    by_script[k] += n
        words = Counter(_WORDS.findall(text.lower()))
        for w in _VOTES.keys() & words.keys():
            for k in _VOTES[w]:
                by_language[k] += words[w]
        scripts.append(by_script)
        votes.append(by_language)
    return pd.DataFrame({"scripts": scripts, "votes": votes})


def detect_language(text: Column, sample: int | None = None) -> Column:
    """struct<code, name, confidence, scripts>: by script shares, else by a vote of function words.

    The whole text counts, or its first ``sample`` characters where that is given.
    """
    names = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])

    def verdict(signs: Column, ranked: Column) -> Column:
        counts = {k: F.element_at(signs["scripts"], i + 1) for i, k in enumerate(SCRIPTS)}
        total = F.greatest(F.aggregate(signs["scripts"], F.lit(0).cast("long"), lambda a, n: a + n), F.lit(1))
        share = {k: n / total for k, n in counts.items()}
        top, second = -ranked[0]["n"], -ranked[1]["n"]
        code, sure = F.when(top > 0, ranked[0]["code"]).otherwise("unknown"), F.when(top > 0, F.bround(0.5 + 0.45 * (1 - second / top), 2)).otherwise(0.0)
        for script, language, least, times, plus in reversed(BY_SCRIPT):
            hit = share[script] > least
            code = F.when(hit, F.lit(language)).otherwise(code)
            sure = F.when(hit, F.bround(F.least(F.lit(0.99), share[script] * times + plus), 2)).otherwise(sure)
        scripts = F.map_filter(F.create_map(*[x for k, v in share.items() for x in (F.lit(k), v)]), lambda _, v: v > 0)
        return F.struct(code.alias("code"), F.coalesce(F.try_element_at(names, code), code).alias("name"), sure.alias("confidence"), scripts.alias("scripts"))

    def ranked(signs: Column) -> Column:
        """Most votes first; n is negative, so that ties keep the languages' order."""
        return F.array_sort(F.array(*[F.struct((-F.element_at(signs["votes"], i + 1)).alias("n"), F.lit(i).alias("place"), F.lit(code).alias("code")) for i, code in enumerate(STOPWORDS)]))

    own = text if sample is None else F.substring(text, 1, sample)
    return let(language_signs(own), lambda s: let(ranked(s), lambda r: verdict(s, r)))


def with_field(struct: Column, name: str, value: Column) -> Column:
    return let(struct, lambda s: s.withField(name, value))


def forced_language(found: Column, code: str) -> Column:
    """The verdict that a caller gives, with the scripts that were found."""
    return let(found, lambda s: F.struct(F.lit(code).alias("code"), F.lit(LANGUAGE_NAMES.get(code, code)).alias("name"), F.lit(1.0).alias("confidence"), s["scripts"].alias("scripts"), F.lit(True).alias("forced")))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


# Fixed value: the format of page-number lines.
PAGE_NUMBER = r"^[ \t\x{a0}]*[-—–\[(]?[ \t\x{a0}]*[0-9]{1,4}[ \t\x{a0}]*[-—–\])]?[ \t\x{a0}]*$"


def without_page_numbers(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(PAGE_NUMBER)), "\n")


def tidy_text(text: Column, language: Column) -> Column:
    """Cleans normalized text: line ends, soft hyphens, page-number lines, hyphen breaks and wrapped lines.

    Blank lines between paragraphs are kept, and joining also accepts the ASCII twins that
    normalization makes of full-width punctuation.
    """
    t = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "­", "")
    t = without_page_numbers(F.regexp_replace(t, "[ \t ]+", " "))
    spaced = F.regexp_replace(t, r"(?U)(\w)-\n(\w)", "$1$2")
    spaced = F.regexp_replace(spaced, r"(?<![.!?:;\"')\]\n])\n(?!\n)(?=[a-zà-öø-ÿ])", " ")
    cjk = r"一-鿿぀-ヿ가-힯"
    unspaced = F.regexp_replace(t, rf"(?<=[{cjk}，、；：）」』】,;:)])\n(?!\n)(?=[{cjk}（「『【(])", "")
    t = F.when(language.isin(*UNSPACED), unspaced).otherwise(spaced)
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def clean_text(text: Column, language: Column) -> Column:
    return tidy_text(nfkc(text), language)


def reading_minutes(text: Column, language: Column) -> Column:
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    minutes = F.when(language.isin("zh", "ja", "ko"), F.length(text) / 260).otherwise(words / 160)
    return F.bround(minutes, 0).cast("int")


def clean_for_speech(text: Column) -> Column:
    """Drops what would be read aloud: stage directions, sound tags and Markdown marks. The order matters."""
    # What speech leaves out.
    steps = [
        (r"[（(]\s*(?:笑|停顿|轻笑|叹气|sigh|laughs?|pause)\s*[)）]", "…"),
        (r"[\[【]\s*(?:BGM|音效|SFX|sfx)[^\]】]*[\]】]", ""),
        (r"\*\*(.+?)\*\*", "$1"), (r"\*(.+?)\*", "$1"), (r"`(.+?)`", "$1"), (r"~~(.+?)~~", "$1"),
        (r"\[(.+?)\]\(.+?\)", "$1"), (r"(?m)^#{1,6}\s*", ""), (r"(?m)^>\s*", ""), (r"\s+", " "),
    ]
    for pattern, to in steps:
        text = F.regexp_replace(text, "(?Ud)" + pattern, to)
    return F.trim(text)


# Fixed value: where sentences end.
SENTENCE_END = r"(?U)(?<=[。！？!?；;…])\s*|(?<=[.!?])\s+(?=[A-Z\"'“])"


def split_sentences(text: Column) -> Column:
    parts = F.filter(F.split(text, SENTENCE_END), lambda p: p.rlike(r"(?U)\S"))
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def title_key(title: Column, normalize: bool = True) -> Column:
    """Titles without brackets, punctuation and white space, in lower case."""
    t = F.coalesce(title, F.lit(""))
    marks = r"[《》〈〉「」【】\[\]（）()：:·,，、.。!！?？\-—_/\\\s]"
    return F.lower(F.regexp_replace(nfkc(t) if normalize else t, "(?U)" + marks, ""))


def chinese_number(s: Column) -> Column:
    """Chapter numerals up to the hundreds: 十二 is 12, 二百零三 is 203."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("digit"))
    place = lambda ch: F.instr(F.lit("零一二三四五六七八九"), ch) - 1
    return F.aggregate(
        F.filter(F.split(s, ""), lambda c: c != ""), start,
        lambda acc, ch: F.when(ch.isin("十", "百"), F.struct((acc["sum"] + F.greatest(acc["digit"], F.lit(1)) * F.when(ch == "十", 10).otherwise(100)).alias("sum"), F.lit(0).alias("digit")))
        .otherwise(F.struct(acc["sum"].alias("sum"), F.greatest(place(ch), F.lit(0)).alias("digit"))),
        lambda acc: acc["sum"] + acc["digit"],
    )


def clock_text(seconds: Column) -> Column:
    """h:mm:ss or m:ss; blank if unknown."""
    s = F.floor(seconds).cast("int")
    long = F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60)
    short = F.format_string("%d:%02d", F.floor(s / 60).cast("int"), s % 60)
    return F.when(s.isNull(), "").when(s >= 3600, long).otherwise(short)


def safe_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r'[\\/:*?"<>|\r\n\t]+', " "))


def episode_id(given: Column) -> Column:
    """``3`` and ``03`` become ``ep03``, ``123`` becomes ``ep123``; ids stay."""
    g = F.lower(F.trim(given))
    return F.when(g.rlike("^[0-9]+$"), F.concat(F.lit("ep"), F.lpad(g, F.greatest(F.length(g), F.lit(2)), F.lit("0")))).otherwise(g)


def score_of(raw: Column) -> Column:
    """Scores given in tenths of a percent are brought to percent; 0 and missing are null."""
    return F.nullif(F.when(raw > 100, F.bround(raw / 10, 1)).otherwise(raw.cast("double")), F.lit(0.0))


def markdown_title(notes: Column, otherwise: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(F.coalesce(notes, F.lit("")), r"(?md)^# (.*)$", 1)), F.lit("")), otherwise)


def segment_hash(engine: Column, voice: Column, text: Column, options_json: Column | None = None) -> Column:
    opts = F.coalesce(options_json, F.lit("{}")) if options_json is not None else F.lit("{}")
    return F.substring(F.sha1(F.concat_ws("|", engine, voice, opts, text).cast("binary")), 1, 12)


@F.pandas_udf(T.StringType())
def sorted_options(options: pd.Series) -> pd.Series:
    """A map of options as JSON with sorted keys, as the segment hash wants it."""
    import json

    return options.map(lambda o: json.dumps(dict(o) if o is not None else {}, sort_keys=True))
