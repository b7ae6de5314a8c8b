"""Audits: storage by owner with risk classes, segments on disk, control totals, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def risk_class(kind: Column, expired: Column) -> Column:
    """Expired artifacts cost nothing to delete, active ones need a question, caches come back."""
    return F.when((kind == "artifact") & expired, "zero").when(kind == "artifact", "low, confirm").when(kind == "cache", "low").otherwise("unknown")


def storage_audit(storage: DataFrame, now: str, retention_days: int = 90) -> DataFrame:
    """repo, kind, risk, n, bytes, share of the repo's bytes: storage (repo, kind, size_in_bytes, created_at, optional expired) by risk.

    Where expired isn't given, a row is expired once it is older than the retention.
    """
    age = F.col("created_at") < F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(retention_days))
    expired = F.coalesce(F.col("expired"), age) if "expired" in storage.columns else age
    by = storage.groupBy("repo", "kind", risk_class(F.col("kind"), expired).alias("risk")).agg(F.count("*").alias("n"), F.sum("size_in_bytes").alias("bytes"))
    return by.withColumn("share", F.col("bytes") / F.nullif(F.sum("bytes").over(W.partitionBy("repo")), F.lit(0)))


def scanned_repos(repos: DataFrame) -> DataFrame:
    """Repositories (repo, total_count) that have anything to list."""
    return repos.filter("total_count > 0")


def largest_consumer(storage: DataFrame) -> DataFrame:
    return storage.groupBy("repo").agg(F.sum("size_in_bytes").alias("bytes")).orderBy(F.desc("bytes"), "repo").limit(1)


def http_outcome(status: Column) -> Column:
    return F.when(status == 204, "ok").when(status == 404, "gone").when(status.isin(409, 422), "skip").when(status == 401, "token").otherwise("error")


def segment_audit(expected: DataFrame, found: DataFrame) -> DataFrame:
    """episode, line_no, problem (missing, empty, stale): expected (episode, line_no, hash) against found (episode, line_no, hash, size)."""
    have = found.select("episode", "line_no", F.col("hash").alias("found_hash"), "size")
    joined = expected.select("episode", "line_no", "hash").join(have, ["episode", "line_no"], "left")
    problem = F.when(F.col("size").isNull(), "missing").when(F.col("size") == 0, "empty").when(~F.col("hash").eqNullSafe(F.col("found_hash")), "stale")
    return joined.select("episode", "line_no", problem.alias("problem")).filter("problem is not null")


def empty_segment_lines(files: DataFrame, lines: DataFrame) -> DataFrame:
    """episode, line_no, speaker, text of the lines whose segment file (episode, path, length) is empty; seg_0007 is line 6."""
    empty = files.filter("length = 0").select("episode", (F.regexp_extract("path", r"seg_(\d+)[^/]*$", 1).try_cast("int") - 1).alias("line_no")).filter("line_no is not null").distinct()
    return lines.join(empty, ["episode", "line_no"]).select("episode", "line_no", "speaker", "text")


def segments_ready(problems: DataFrame, episodes: DataFrame) -> DataFrame:
    """episode, n_problems, ready of all episodes: a manifest may be written only without missing and empty segments."""
    bad = problems.filter("problem in ('missing', 'empty')").groupBy("episode").agg(F.count("*").alias("n_problems"))
    n = F.coalesce("n_problems", F.lit(0))
    return episodes.select("episode").distinct().join(bad, "episode", "left").select("episode", n.alias("n_problems"), (n == 0).alias("ready"))


def extraction_checks(extracted: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """id, rule of extracted (id, declared, chars, n_images, n_empty): length of another order of magnitude, no images, empty chapters."""
    ratio = F.col("chars") / F.nullif(F.col("declared"), F.lit(0))
    rules = {"length": ~F.coalesce(ratio.between(1 / tolerance, tolerance), F.lit(False)), "images": F.coalesce("n_images", F.lit(0)) == 0, "empty_chapter": F.coalesce("n_empty", F.lit(0)) > 0}
    found = F.array(*[F.when(hit, F.lit(name)) for name, hit in rules.items()])
    return extracted.select("id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("rule"))


def file_counts(files: DataFrame) -> DataFrame:
    """folder, n_files, n_empty, bytes of files (path, length)."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return files.groupBy(folder.alias("folder")).agg(F.count("*").alias("n_files"), F.count_if(F.col("length") == 0).alias("n_empty"), F.sum("length").alias("bytes"))


def control_totals(declared: DataFrame, extracted: DataFrame, key: str, tolerance: float = 10.0) -> DataFrame:
    """key, declared, extracted, ratio, verdict: both sides' totals (key, total) must be of one order of magnitude."""
    both = declared.select(key, F.col("total").alias("declared")).join(extracted.select(key, F.col("total").alias("extracted")), key, "full")
    ratio = F.col("extracted") / F.nullif(F.col("declared"), F.lit(0))
    verdict = F.when(F.col("extracted").isNull(), "not extracted").when(F.col("declared").isNull(), "not declared").when(ratio.between(1 / tolerance, tolerance), "plausible").otherwise("implausible")
    return both.withColumn("ratio", ratio).withColumn("verdict", verdict)


def conflicts(body: DataFrame, image: DataFrame, key: str) -> DataFrame:
    """key, body, image: attributes (key, value) whose values differ or that one side lacks."""
    both = body.select(key, F.col("value").alias("body")).join(image.select(key, F.col("value").alias("image")), key, "full")
    return both.filter(~F.col("body").eqNullSafe(F.col("image")))


def key_age(keys: DataFrame, now: str, remind_days: int = 80) -> DataFrame:
    age = F.date_diff(F.to_date(F.lit(now)), F.to_date("created_at"))
    return keys.withColumn("age_days", age).withColumn("remind", age > remind_days)


def folders(items: DataFrame, strict: bool = False) -> DataFrame:
    """Items (media_id, media_type) that are folders; strict: by type alone."""
    by_type = F.col("media_type").cast("string") == "99"
    return items.filter(by_type if strict else by_type | F.startswith("media_id", F.lit("folder_")))


def episode_count(total_chars: Column) -> Column:
    """How many episodes a book of that size suits."""
    return F.when(total_chars < 50_000, "2-3").when(total_chars < 150_000, "4-6").when(total_chars < 300_000, "6-10").otherwise("10-15")
