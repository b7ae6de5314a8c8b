"""Publishing: file names, feed items, the feed's XML and the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as T

# Content types of uploads by extension.
MIME = {"mp3": "audio/mpeg", "m4a": "audio/mp4", "wav": "audio/wav", "md": "text/markdown", "txt": "text/plain", "pdf": "application/pdf", "html": "text/html", "json": "application/json"}
AUTOMATIC, DECLARED = 100 * 2**20, 200 * 2**20


def name_plan(episodes: DataFrame, pattern: str = "{prefix}{ep}__{title}.mp3", prefix: str = "") -> DataFrame:
    """Adds file_name to episodes (ep, title): the template filled in, without signs that file systems reject."""
    title = T.safe_name(F.coalesce("title", F.lit("")))
    name = F.replace(F.replace(F.replace(F.lit(pattern), F.lit("{prefix}"), F.lit(prefix)), F.lit("{ep}"), F.col("ep")), F.lit("{title}"), title)
    return episodes.withColumn("file_name", F.replace(name, F.lit("__."), F.lit(".")))


def name_by_chapter(files: DataFrame, episodes: DataFrame) -> DataFrame:
    """Adds new_name to files (name): ``ep_range_topic`` of the episode its name mentions; the last of repeated ids wins; else the name."""
    ep = F.lower(F.regexp_extract("name", r"(?i)(ep\d+)", 1))
    known = episodes.groupBy(F.lower("id").alias("ep")).agg(F.max_by(F.struct("chapter_range", "topic"), F.col("ord")).alias("e"))
    ext = F.regexp_extract("name", r"(\.[^.]+)$", 1)
    fresh = F.concat(T.safe_name(F.concat_ws("_", ep, T.blank_to_null(F.col("e.chapter_range")), T.blank_to_null(F.col("e.topic")))), ext)
    return files.withColumn("ep", ep).join(known, "ep", "left").withColumn("new_name", F.when(F.col("e").isNull(), F.col("name")).otherwise(fresh)).drop("e")


def episode_titles(names: DataFrame, scripts: DataFrame, episodes: DataFrame) -> DataFrame:
    """names (ep) with their title: that of the script (ep, title), else the episode's topic, else its title (id, topic, title), else blank."""
    script = scripts.groupBy(F.lower("ep").alias("ep")).agg(F.max(T.blank_to_null(F.col("title"))).alias("script_title"))
    known = episodes.groupBy(F.lower("id").alias("ep")).agg(F.max(F.struct(T.blank_to_null(F.col("topic")).alias("topic"), T.blank_to_null(F.col("title")).alias("title"))).alias("e"))
    both = names.withColumn("ep", F.lower("ep")).join(script, "ep", "left").join(known, "ep", "left")
    return both.withColumn("title", F.coalesce("script_title", "e.topic", "e.title", F.lit(""))).drop("script_title", "e")


def select_episodes(episodes: DataFrame, only: list[str], id_col: str = "id") -> DataFrame:
    """Episodes named by their id, or by the number behind its ``ep``; none named: all."""
    wanted = [w.strip().lower() for w in only if w.strip()]
    own = F.lower(id_col)
    return episodes.filter(own.isin(wanted) | F.regexp_extract(own, "^ep(.*)$", 1).isin(wanted)) if wanted else episodes


def in_file_order(files: DataFrame, name_col: str = "name", numeric: bool = False) -> DataFrame:
    """Adds place: by name (ep10 before ep2), or by the first number in the name and then by name."""
    number = F.regexp_extract(name_col, r"(\d+)", 1).try_cast("long")
    order = [F.asc_nulls_last(number)] if numeric else []
    return files.withColumn("place", F.row_number().over(W.partitionBy("show_id").orderBy(*order, name_col)))


def tracks(files: DataFrame) -> DataFrame:
    """show_id, name, track, n_tracks in the order of names."""
    return files.select("show_id", "name", F.row_number().over(W.partitionBy("show_id").orderBy("name")).alias("track"), F.count("*").over(W.partitionBy("show_id")).alias("n_tracks"))


def framed(body: DataFrame, intro: DataFrame, outro: DataFrame) -> DataFrame:
    """The parts of each episode (episode, part, file): its intro, its segments by number, its outro; seq counts them."""
    rows = [d.withColumn("_frame", F.lit(k)) for k, d in enumerate((intro, body, outro))]
    order = W.partitionBy("episode").orderBy("_frame", "part")
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("seq", F.row_number().over(order)).drop("_frame")


def with_notes(audio: DataFrame, notes: DataFrame) -> DataFrame:
    """audio (show_id, name) with the notes (show_id, name, text) of the same stem, where there are any."""
    stem = F.regexp_replace("name", r"\.[^.]+$", "")
    own = notes.groupBy("show_id", stem.alias("_stem")).agg(F.max("text").alias("notes"))
    return audio.withColumn("_stem", stem).join(own, ["show_id", "_stem"], "left").drop("_stem")


def script_file_violations(files: DataFrame) -> DataFrame:
    """name, rule of script files (name, episode_id): ``ep`` and two digits or more, and an id that starts like the name."""
    stem = F.regexp_extract("name", r"^(ep\d{2,})\.script\.json$", 1)
    rules = {"name": stem == "", "id": (stem != "") & ~F.coalesce(F.startswith("episode_id", stem), F.lit(False))}
    found = F.array(*[F.when(hit, F.lit(k)) for k, hit in rules.items()])
    return files.select("name", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("rule"))


def episode_field_violations(episodes: DataFrame) -> DataFrame:
    """id, field: what must be present in an episode and isn't."""
    found = F.array(*[F.when(T.blank_to_null(F.col(c)).isNull(), F.lit(c)) for c in ("id", "title", "chapter_range", "topic")])
    return episodes.select("id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("field"))


def feed_items(audio: DataFrame, show: str, base_url: str, now: str) -> DataFrame:
    """Items of audio (show_id, name, length, seconds, notes): newest last by name; ``now`` is a UTC timestamp."""
    by_name = W.partitionBy("show_id").orderBy("name")
    stem = F.regexp_replace("name", r"\.[^.]+$", "")
    title = T.markdown_title(F.col("notes"), stem)
    number = F.row_number().over(by_name)
    days = F.count("*").over(W.partitionBy("show_id")) - number
    date = F.date_format(F.to_timestamp(F.lit(now)) - F.make_dt_interval(days.cast("int")), "EEE, dd MMM yyyy HH:mm:ss Z")
    base = base_url.rstrip("/")
    url = F.concat(F.lit(base + "/"), F.col("name")) if base else F.col("name")
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))), F.lit("audio/mpeg"))
    return audio.select("show_id", number.alias("episode"), title.alias("title"), F.coalesce(T.blank_to_null(F.col("notes")), title).alias("description"), F.concat(F.lit(f"{show}-"), stem).alias("guid"), date.alias("pub_date"), url.alias("url"), "length", kind.alias("type"), T.clock_text(F.col("seconds")).alias("duration"))


def _escaped(c):
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def feed_xml(items: DataFrame, show: str, author: str, language: str, description: str = "", link: str = ".") -> DataFrame:
    """show_id, xml: an RSS document with podcast tags."""
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), _escaped(c), F.lit(f"</{name}>"))
    enclosure = F.concat(F.lit('<enclosure url="'), _escaped(F.col("url")), F.lit('" length="'), F.col("length").cast("string"), F.lit('" type="'), F.col("type"), F.lit('"/>'))
    duration = F.when(F.col("duration") != "", tag("itunes:duration", F.col("duration"))).otherwise("")
    item = F.concat(F.lit("<item>"), tag("title", F.col("title")), tag("description", F.col("description")), F.lit('<guid isPermaLink="false">'), _escaped(F.col("guid")), F.lit("</guid>"), tag("pubDate", F.col("pub_date")), enclosure, duration, tag("itunes:episode", F.col("episode").cast("string")), F.lit("</item>"))
    head = F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?><rss version="2.0" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd"><channel>'), tag("title", F.lit(show)), tag("link", F.lit(link)), tag("language", F.lit(language)), tag("description", F.lit(description or show)), tag("itunes:author", F.lit(author)), tag("itunes:explicit", F.lit("false")))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("episode", item.alias("xml")))), lambda x: x["xml"])
    return items.groupBy("show_id").agg(F.concat(head, F.array_join(ordered, ""), F.lit("</channel></rss>")).alias("xml"))


def index_page(items: DataFrame, show: str, description: str = "") -> DataFrame:
    """show_id, markdown."""
    extra = F.when(F.col("duration") != "", F.concat(F.lit(" · "), F.col("duration"))).otherwise("")
    entry = F.concat(F.lit("\n## "), F.col("episode").cast("string"), F.lit(". "), F.col("title"), F.lit("\n\n- 音频: "), F.col("url"), extra, F.lit(" · "), F.format_number(F.col("length") / 2**20, 1), F.lit(" MB\n"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("episode", entry.alias("md")))), lambda x: x["md"])
    head = F.concat(F.lit(f"# {show}\n\n" + (f"> {description}\n\n" if description else "") + "共 "), F.count("*").cast("string"), F.lit(" 集\n"))
    return items.groupBy("show_id").agg(F.concat(head, F.array_join(ordered, "")).alias("markdown"))


def upload_manifest(files: DataFrame) -> DataFrame:
    """file_name, file_size, file_ext, content_type, gate of files (name, length); an unknown extension is rejected."""
    ext = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), ext)
    gate = F.when(kind.isNull(), "rejected").when(F.col("length") < AUTOMATIC, "automatic").when(F.col("length") <= DECLARED, "manual").otherwise("too large")
    return files.select(F.col("name").alias("file_name"), F.col("length").alias("file_size"), ext.alias("file_ext"), kind.alias("content_type"), gate.alias("gate"))


def index_upsert(index: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Stale entries make way for fresh ones of the same key."""
    return index.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def select_files(files: DataFrame, directories: list[str], suffixes: list[str], names: list[str]) -> DataFrame:
    """files (rel) without excluded path parts, suffixes and names."""
    parts = F.split("rel", "/")
    bad = F.arrays_overlap(parts, F.array(*[F.lit(d) for d in [*directories, *names]])) if directories or names else F.lit(False)
    for s in suffixes:
        bad = bad | F.endswith("rel", F.lit(s))
    return files.filter(~bad)


def front_matter_violations(files: DataFrame) -> DataFrame:
    """name, rule: text must start with a block that names it in hyphen case and describes it without angle brackets."""
    block = F.regexp_extract("text", r"(?ds)\A---\n(.*?)\n---", 1)
    own, about = F.trim(F.regexp_extract(block, r"(?md)^name:(.*)$", 1)), F.trim(F.regexp_extract(block, r"(?md)^description:(.*)$", 1))
    rules = {"block": block == "", "name": (block != "") & ~own.rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), "description": (block != "") & ((about == "") | about.rlike("[<>]"))}
    found = F.array(*[F.when(hit, F.lit(k)) for k, hit in rules.items()])
    return files.select("name", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("rule"))
