"""Dialogue scripts: voices, render segments with content hashes, reuse, cost, statistics and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as T

# Price of a million characters by engine.
PRICES = {"edge": 0.0, "say": 0.0, "aliyun": 200.0, "volcano": 250.0, "minimax": 300.0, "openai": 430.0}
# The engines a script may name.
ENGINES = ["edge", "openai", "aliyun", "volcano", "minimax", "say"]
# Characters or words a minute by language.
SPEEDS = {"zh": (250, 280), "ja": (350, 400), "ko": (300, 340), "en": (150, 170), "es": (140, 160), "fr": (140, 160), "de": (140, 160)}


# Formulas that no script may open with.
BANNED_OPENINGS = ["欢迎收听本期节目", "大家好我是", "今天我们要讲的是"]
# Seconds of pause after a line by what it does.
PAUSES = {"question": 0.8, "conclusion": 1.0, "topic switch": 1.5, "end": 1.2}
# Characters of a sentence in unspaced scripts, words of one in spaced scripts, at most.
LONGEST_CHARS, LONGEST_WORDS = 40, 25


def explode_lines(scripts: DataFrame) -> DataFrame:
    """episode, line_no and the fields of each line."""
    return scripts.select(F.col("episode_id").alias("episode"), "engine", "default_gap", F.posexplode("lines").alias("line_no", "l")).select("episode", "engine", "default_gap", "line_no", "l.*")


def resolve_voice(config: Column, engine: Column) -> tuple[Column, Column]:
    """(voice, options) of a speaker's VARIANT: a name, or an object with a voice, or with one for each engine."""
    plain = F.try_variant_get(config, "$", "string")
    plain = F.when(F.schema_of_variant(config) == "STRING", plain)
    by_engine = {e: (F.try_variant_get(config, f"$.{e}", "string"), F.try_variant_get(config, f"$.{e}", "map<string,string>")) for e in ENGINES}
    named, nested = F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")
    for e, (name, inner) in by_engine.items():
        named = F.when((engine == e) & inner.isNull(), name).otherwise(named)
        nested = F.when(engine == e, inner).otherwise(nested)
    voice = T.first_present(plain, F.try_element_at(nested, F.lit("voice")), named, F.try_variant_get(config, "$.voice", "string"))
    empty = F.create_map().cast("map<string,string>")
    own = F.coalesce(F.try_variant_get(config, "$", "map<string,string>"), empty)
    options = F.map_filter(own, lambda k, _: ~k.isin("voice", *ENGINES))
    inner = F.map_filter(F.coalesce(nested, empty), lambda k, _: k != "voice")
    return voice, merge_options(options, inner)


def merge_options(left: Column, right: Column) -> Column:
    """Options of both maps; the right one's win."""
    keep = F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))
    return F.map_concat(keep, right)


def plan_segments(lines: DataFrame, engine: str | None = None) -> DataFrame:
    """episode, line_no, speaker, voice, text, chars, hash, file: what is to be rendered, in order.

    lines: episode, line_no, speaker, text, voice (resolved), optional options (map) and engine.
    Lines without text after cleaning are not rendered; numbers are kept.
    """
    used = F.lit(engine) if engine else F.col("engine")
    cleaned = lines.withColumn("text", T.clean_for_speech(F.coalesce("text", F.lit("")))).filter("text <> ''")
    options = T.sorted_options("options") if "options" in lines.columns else None
    return cleaned.withColumns({"chars": F.length("text"), "hash": T.segment_hash(used, F.col("voice"), F.col("text"), options), "file": F.format_string("seg_%04d", F.col("line_no") + 1)})


def line_voices(lines: DataFrame, voices: DataFrame, engine: str) -> DataFrame:
    """lines (episode, line_no, speaker, text, voice: its own or null) with voice and options: their own voice, else their speaker's (episode, speaker, config)."""
    voice, options = resolve_voice(F.col("config"), F.lit(engine))
    known = voices.select("episode", "speaker", voice.alias("_voice"), options.alias("options"))
    return lines.join(known, ["episode", "speaker"], "left").withColumn("voice", T.first_present(F.col("voice"), F.col("_voice"))).drop("_voice")


def render_manifest(plan: DataFrame, scripts: DataFrame, engine: str, default_gap: float = 0.35) -> DataFrame:
    """episode_id, title, language, engine, segment_count, total_chars, default_gap, segments in order of their lines.

    plan: of plan_segments, optionally with cached, pause_after and chapter; scripts: episode, title, language, default_gap.
    """
    have = lambda c, t: F.col(c) if c in plan.columns else F.lit(None).cast(t)
    segment = F.struct(
        F.col("line_no").cast("int").alias("index"), "speaker", "voice", "text", "chars", "hash", "file",
        have("pause_after", "double").alias("pause_after"), have("chapter", "string").alias("chapter"), F.coalesce(have("cached", "boolean"), F.lit(False)).alias("cached"),
    )
    by = plan.groupBy("episode").agg(F.count("*").cast("int").alias("segment_count"), F.sum("chars").cast("int").alias("total_chars"), F.sort_array(F.collect_list(segment)).alias("segments"))
    whole = by.join(scripts.select("episode", "title", "language", F.col("default_gap").alias("_gap")), "episode", "left")
    return whole.select(F.col("episode").cast("string").alias("episode_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("language", F.lit("")).alias("language"), F.lit(engine).alias("engine"), "segment_count", "total_chars", F.coalesce("_gap", F.lit(default_gap)).alias("default_gap"), "segments")


def reuse(plan: DataFrame, rendered: DataFrame) -> DataFrame:
    """Adds cached: a rendered segment (episode, line_no, hash, size) of equal number and hash with content exists."""
    have = rendered.filter("size > 0").select("episode", "line_no", "hash").distinct().withColumn("cached", F.lit(True))
    return plan.join(have, ["episode", "line_no", "hash"], "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def unknown_speakers(lines: DataFrame, voices: DataFrame) -> DataFrame:
    """Lines whose speaker (episode, speaker) has no voice."""
    return lines.join(voices.select("episode", "speaker").distinct(), ["episode", "speaker"], "left_anti")


def cost(plan: DataFrame, engine: str) -> DataFrame:
    """episode, n_segments, chars, cost of an engine."""
    price = F.lit(PRICES[engine])
    return plan.groupBy("episode").agg(F.count("*").alias("n_segments"), F.sum("chars").alias("chars"), (F.sum("chars") * price / 1_000_000).alias("cost"))


def speaker_share(lines: DataFrame) -> DataFrame:
    """episode, speaker, n_lines, chars, share of the episode's characters."""
    by = lines.groupBy("episode", "speaker").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("chars"))
    return by.withColumn("share", F.col("chars") / F.sum("chars").over(W.partitionBy("episode")))


def length_budget(lines: DataFrame, low: int = 4500, high: int = 5500) -> DataFrame:
    chars = F.sum(F.length("text"))
    return lines.groupBy("episode").agg(F.count("*").alias("n_lines"), chars.alias("chars"), F.when(chars < low, "short").when(chars > high, "long").otherwise("fits").alias("verdict"))


def target_fit(episodes: DataFrame) -> DataFrame:
    """Adds low_chars, high_chars and fits to episodes (language, target_minutes, units: characters or words)."""
    low, high = (F.create_map(*[F.lit(x) for k, v in SPEEDS.items() for x in (k, v[i])]) for i in (0, 1))
    bounds = [F.try_element_at(m, F.col("language")) * F.col("target_minutes") for m in (low, high)]
    return episodes.withColumns({"low_units": bounds[0], "high_units": bounds[1], "fits": F.col("units").between(*bounds)})


def line_violations(lines: DataFrame, least: int = 20, most: int = 120) -> DataFrame:
    """episode, line_no, rule, detail: one row for each rule that a line breaks.

    A sentence is too long by its characters where the line has Chinese, Japanese or Korean ones, else by its words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.length(text)
    sentences = T.split_sentences(text)
    words = F.array_max(F.transform(sentences, lambda s: F.size(F.split(F.trim(s), r"\s+"))))
    signs = F.array_max(F.transform(sentences, lambda s: F.length(F.trim(s))))
    unspaced = text.rlike("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
    fillers = F.regexp_count(F.lower(text), F.lit(r"\b(um|uh|well|you know|i mean)\b|嗯|呃|那个"))
    rules = [
        ("empty_text", F.trim(text) == "", n),
        ("line_short", (F.trim(text) != "") & (n < least), n),
        ("line_long", n > most, n),
        ("sentence_long", F.when(unspaced, signs > LONGEST_CHARS).otherwise(words > LONGEST_WORDS), F.when(unspaced, signs).otherwise(words)),
        ("markdown", text.rlike(r"\*\*|^#{1,6} |`|\]\("), n),
        ("numeric_share", text.rlike(r"[0-9]+ ?[%/] ?[0-9]*"), n),
        ("fillers", fillers * 100 > 2 * n, fillers),
    ]
    found = F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(name).alias("rule"), detail.cast("int").alias("detail"))) for name, hit, detail in rules])
    return lines.select("episode", "line_no", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("v")).select("episode", "line_no", "v.rule", "v.detail")


def banned_openings(lines: DataFrame, banned: list[str] | None = None) -> DataFrame:
    """episode, opening: episodes whose first line with text starts with a formula (signs between its characters don't count)."""
    spoken = lines.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    first = spoken.groupBy("episode").agg(F.min_by("text", "line_no").alias("text"))
    plain = F.regexp_replace("text", r"[\s，,。.!！、：:]+", "")
    hits = F.filter(F.array(*[F.lit(b) for b in banned or BANNED_OPENINGS]), lambda b: F.startswith(plain, F.regexp_replace(b, r"[\s，,。.!！、：:]+", "")))
    return first.select("episode", F.try_element_at(hits, F.lit(1)).alias("opening")).filter("opening is not null")


def suggested_pauses(lines: DataFrame) -> DataFrame:
    """episode, line_no, reason, pause_s: a pause after the last line, before a line that opens a chapter, and after questions."""
    order = W.partitionBy("episode").orderBy("line_no")
    last = F.lead("line_no").over(order).isNull()
    opens = F.coalesce(F.trim(F.lead("chapter").over(order)) != "", F.lit(False))
    reason = F.when(last, "end").when(opens, "topic switch").when(F.trim("text").rlike("[?？]$"), "question")
    pause = F.try_element_at(F.create_map(*[F.lit(x) for kv in PAUSES.items() for x in kv]), F.col("reason"))
    return lines.select("episode", "line_no", reason.alias("reason")).filter("reason is not null").withColumn("pause_s", pause)


def script_violations(scripts: DataFrame) -> DataFrame:
    """episode_id, rule: required fields, id format, engine, gaps, at least one voice (a VARIANT object) and one line."""
    rules = {
        "episode_id": F.col("episode_id").isNull() | ~F.col("episode_id").rlike("^[A-Za-z0-9_-]+$"),
        "title": F.coalesce(F.trim("title"), F.lit("")) == "",
        "engine": F.col("engine").isNotNull() & ~F.col("engine").isin(ENGINES),
        "default_gap": F.col("default_gap").isNotNull() & ~F.col("default_gap").between(0, 3),
        "voices": ~F.coalesce(F.size(F.try_variant_get("voices", "$", "map<string,variant>")) > 0, F.lit(False)),
        "lines": F.coalesce(F.size("lines"), F.lit(0)) < 1,
        "pause_after": F.exists("lines", lambda x: x["pause_after"].isNotNull() & ~x["pause_after"].between(0, 5)),
        "line_text": F.exists("lines", lambda x: F.coalesce(F.length(x["text"]), F.lit(0)) < 1),
    }
    found = F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.lit(name)) for name, hit in rules.items()])
    return scripts.select("episode_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("rule"))


def questions(lines: DataFrame, host: str, least: int = 5) -> DataFrame:
    asked = F.sum(F.when((F.col("speaker") == host) & F.col("text").rlike("[?？]"), 1).otherwise(0))
    return lines.groupBy("episode").agg(asked.alias("n_questions"), (asked >= least).alias("enough"))


def repair_script_json(raw: Column) -> Column:
    """``"speaker": "x": "text":`` with a colon for a comma."""
    return F.regexp_replace(raw, r'("speaker"\s*:\s*"[^"]*")\s*:\s*("text"\s*:)', "$1, $2")
