"""Registered queries of rules, lookups and sinks that the test tables don't trigger by themselves: their inputs are made from whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import audit, catalog, chapters, dialogue, graph, pages, publish, timeline
from corvane.plans.catalog_queries import _LINES, _planned, script_lines, table
from corvane.sources import readers

NOW = "2024-02-01 00:00:00"


def text_of(c: str) -> Column:
    return F.col(c).cast("string")


def pick(number: Column, *values) -> Column:
    """The value at number modulo their count."""
    return F.element_at(F.array(*[F.lit(v) if isinstance(v, (str, int, float)) else v for v in values]), (number % len(values)).cast("int") + 1)


def q_episode_ids(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", pick(F.col("page_id"), text_of("page_id"), F.concat(F.lit("EP"), text_of("page_id"))).alias("given"))
    return p.select("page_id", T.episode_id(F.col("given")).alias("ep"))


def q_page_number_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("- "), text_of("doc_id"), F.lit(" -\n"), "text", F.lit("\n "), text_of("doc_id"), F.lit("\nPage 7")).alias("t"))
    return d.select("doc_id", T.without_page_numbers(F.col("t")).alias("t")).select("doc_id", F.sha1(F.col("t").cast("binary")).alias("sha1"))


def q_short_sections(spark, sf_dir):
    return pages.drop_short_sections(table(spark, sf_dir, "conversations")).select("conv_id", "turn")


def q_known_titles(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("ord"), pick(F.col("turn"), F.substring("text", 1, 12), F.substring("text", 1, 125), F.lit("  "), F.lit(" Again ")).alias("title"))
    return pages.known_titles(c)


def _items(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.concat(pick(F.col("event_id"), "folder_", "file_", "x_"), text_of("event_id")).alias("media_id"), (F.col("event_id") % 100).cast("string").alias("media_type"))


def q_folders(spark, sf_dir):
    return audit.folders(_items(spark, sf_dir)).select("event_id", F.lit("loose").alias("rule")).unionByName(audit.folders(_items(spark, sf_dir), strict=True).select("event_id", F.lit("strict").alias("rule")))


def q_folder_gate(spark, sf_dir):
    wanted = table(spark, sf_dir, "documents").select(F.col("source").alias("name"))
    have = table(spark, sf_dir, "pages").select(F.concat(F.lit("src"), (F.col("page_id") % 9).cast("string")).alias("name"), F.concat(F.lit("folder_"), text_of("page_id")).alias("media_id"))
    return catalog.folder_gate(wanted, have)


def q_scanned_repos(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("repo"), text_of("user_id")).alias("repo")).agg(F.count_if(F.col("event_type") == "error").alias("total_count"))
    return audit.scanned_repos(e)


def q_voice_catalogue(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(pick(F.col("n_nationkey"), "en-", "zh-", "EN-"), "n_name").alias("Locale"), F.concat(F.lit("v"), text_of("n_nationkey")).alias("ShortName"))
    return readers.voice_catalogue(n, "en")


def q_largest_consumer(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return audit.largest_consumer(e.select(F.concat(F.lit("repo"), text_of("user_id")).alias("repo"), F.col("event_id").alias("size_in_bytes")))


def q_file_counts(spark, sf_dir):
    f = table(spark, sf_dir, "conversations").select(F.concat(F.lit("seg/"), text_of("conv_id"), F.lit("/"), text_of("turn"), F.lit(".mp3")).alias("path"), F.when(F.col("turn") % 3 == 0, 0).otherwise(F.length("text")).cast("long").alias("length"))
    return audit.file_counts(f)


def q_http_outcomes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", pick(F.col("event_id"), 204, 404, 409, 422, 401, 500).alias("status"))
    return e.select("event_id", audit.http_outcome(F.col("status")).alias("outcome"))


def q_scores(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.score_of((F.col("p_partkey") * 7 % 1001).cast("int")).alias("score"))


def q_key_age(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.date_sub(F.to_date("ts"), (F.col("event_id") % 120).cast("int")).alias("created_at"))
    return audit.key_age(e, NOW).select("event_id", "age_days", "remind")


def q_script_rules(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    line = F.struct(F.col("role").alias("speaker"), pick(F.col("turn") + F.col("conv_id"), F.col("text"), F.col("text"), F.lit("")).alias("text"), pick(F.col("turn") + F.col("conv_id"), 1.0, 2.0, 3.0, 6.0).alias("pause_after"))
    k = F.col("conv_id")
    s = c.groupBy("conv_id").agg(F.collect_list(line).alias("lines")).select(
        F.concat(pick(k, "ep", "ep ", "e-"), text_of("conv_id")).alias("episode_id"), pick(k, "A title", " ").alias("title"), pick(k, "edge", "abacus", "openai").alias("engine"),
        pick(k, 0.35, 3.5, 0.0, 1.0).alias("default_gap"), F.parse_json(pick(k, '{"user": "v"}', "{}", '{"a": {"voice": "w"}}')).alias("voices"), F.when(k % 11 == 0, F.slice("lines", 1, 0)).otherwise(F.col("lines")).alias("lines"),
    )
    return dialogue.script_violations(s)


def q_unknown_speakers(spark, sf_dir):
    lines = script_lines(spark, sf_dir)
    voices = lines.filter("speaker = 'user' or episode % 2 = 0").select("episode", "speaker")
    return dialogue.unknown_speakers(lines, voices).select("episode", "line_no", "speaker")


def q_line_rules(spark, sf_dir):
    lines = script_lines(spark, sf_dir)
    long = "这一句话写得非常长因为它要超过四十个汉字的限制所以还得再多写几个字才算真正地超过了那个限制。"
    more = pick(F.col("line_no"), "", " It grew by 85% since.", long, "um uh well 嗯 um", " ", "**bold** [a](b)")
    text = F.when(F.col("line_no") % 6 == 4, " ").when(F.col("line_no") % 6 == 3, more).otherwise(F.concat("text", more))
    return dialogue.line_violations(lines.withColumn("text", text))


def q_banned_openings(spark, sf_dir):
    lines = script_lines(spark, sf_dir)
    head = F.when(F.col("line_no") == 0, pick(F.col("episode"), "欢迎收听，本期节目", "大家好，我是", "", " ", "今天，我们要讲的是")).otherwise("")
    return dialogue.banned_openings(lines.withColumn("text", F.concat(head, "text")))


def q_suggested_pauses(spark, sf_dir):
    lines = script_lines(spark, sf_dir).withColumn("chapter", F.when(F.col("line_no") % 5 == 3, "C")).withColumn("text", F.concat("text", pick(F.col("line_no"), "", "?", "？ ")))
    return dialogue.suggested_pauses(lines)


def q_explicit_pauses(spark, sf_dir):
    lines = script_lines(spark, sf_dir).withColumns({"duration_ms": F.lit(1000).cast("long"), "pause_after_ms": pick(F.col("line_no"), F.lit(None).cast("int"), 700, 5), "pause_before_ms": F.when(F.col("line_no") % 4 == 1, 900)})
    return timeline.timeline(lines).select("episode", "line_no", "gap_ms", "start_ms", "end_ms")


def q_target_fit(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("language"), (F.col("doc_id") % 9 + 1).alias("target_minutes"), F.size(F.split("text", " ")).alias("units"))
    return dialogue.target_fit(d).select("doc_id", "low_units", "high_units", "fits")


def q_episode_load(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list((F.col("l_partkey") * 2).cast("string")).alias("kp_ids"))
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") * 2).cast("string").alias("id"), F.when(F.col("p_size") % 2 == 0, F.array("p_name")).otherwise(F.array().cast("array<string>")).alias("evidence")).filter("id % 3 <> 0")
    return graph.episode_load(o, p)


def q_episode_fields(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), pick(F.col("turn"), "t", " ", "u").alias("title"), F.when(F.col("turn") % 4 != 1, "1-2").alias("chapter_range"), F.col("text").alias("topic"))
    return publish.episode_field_violations(c)


def q_script_files(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.concat(T.episode_id(text_of("page_id")), pick(F.col("page_id"), ".script.json", ".json", ".script.json")).alias("name"), F.concat(pick(F.col("page_id"), "ep", "ep", "x"), F.lpad(text_of("page_id"), F.greatest(F.length(text_of("page_id")), F.lit(2)), F.lit("0")), F.lit("_t")).alias("episode_id"))
    return publish.script_file_violations(p)


def _problems(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.filter("conv_id % 3 = 0").select(F.col("conv_id").alias("episode"), pick(F.col("turn") + F.col("conv_id"), "missing", "stale", "empty", "stale").alias("problem"))


def q_segments_ready(spark, sf_dir):
    return audit.segments_ready(_problems(spark, sf_dir), table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("episode")))


def q_extraction_checks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") * pick(F.col("doc_id"), 1, 20, 1)).alias("declared"), F.length("text").alias("chars"), (F.col("doc_id") % 4).alias("n_images"), F.when(F.col("doc_id") % 5 == 0, 1).alias("n_empty"))
    return audit.extraction_checks(d)


def q_empty_segment_lines(spark, sf_dir):
    lines = script_lines(spark, sf_dir)
    files = lines.select("episode", F.format_string("out/seg_%04d.mp3", (F.col("line_no") + 1).cast("int")).alias("path"), F.when(F.col("line_no") % 4 == 2, 0).otherwise(9).alias("length"))
    return audit.empty_segment_lines(files, lines)


def q_episode_titles(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    names = p.select(T.episode_id(text_of("page_id")).alias("ep"))
    scripts = p.filter("page_id % 3 = 0").select(F.upper(T.episode_id(text_of("page_id"))).alias("ep"), pick(F.col("page_id"), F.concat(F.lit("S"), text_of("page_id")), F.lit(" ")).alias("title"))
    episodes = p.filter("page_id % 4 <> 1").select(T.episode_id(text_of("page_id")).alias("id"), pick(F.col("page_id"), " ", F.concat(F.lit("T"), text_of("page_id")), F.lit(None).cast("string")).alias("topic"), F.concat(F.lit("E"), text_of("page_id")).alias("title"))
    return publish.episode_titles(names, scripts, episodes)


def q_selected_episodes(spark, sf_dir):
    return publish.select_episodes(table(spark, sf_dir, "pages").select(T.episode_id(text_of("page_id")).alias("id")), ["EP07", "12", " ", "240"])


def _audio(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("show_id"), F.concat(F.lit("ep"), text_of("turn"), pick(F.col("turn"), "_a", "")).alias("stem"), F.concat(F.lit("ep"), text_of("turn"), pick(F.col("turn"), "_a", ""), F.lit(".mp3")).alias("name"), "turn", "text")


def q_file_order(spark, sf_dir):
    plain = publish.in_file_order(_audio(spark, sf_dir)).select("show_id", "name", "place")
    return plain.join(publish.in_file_order(_audio(spark, sf_dir), numeric=True).select("show_id", "name", F.col("place").alias("numeric_place")), ["show_id", "name"])


def q_tracks(spark, sf_dir):
    return publish.tracks(_audio(spark, sf_dir))


def q_framed_episodes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    body = c.select(F.col("conv_id").alias("episode"), F.col("turn").alias("part"), F.format_string("seg_%04d", (F.col("turn") + 1).cast("int")).alias("file"))
    ends = lambda name, some: c.filter(some).select(F.col("conv_id").alias("episode"), F.lit(0).cast("long").alias("part"), F.lit(name).alias("file")).distinct()
    return publish.framed(body, ends("intro", "conv_id % 2 = 0"), ends("outro", "conv_id % 3 = 0")).select("episode", "seq", "file")


def q_notes(spark, sf_dir):
    notes = _audio(spark, sf_dir).filter("turn % 2 = 0").select("show_id", F.concat("stem", F.lit(".md")).alias("name"), "text")
    return publish.with_notes(_audio(spark, sf_dir).select("show_id", "name"), notes)


def q_names_by_chapter(spark, sf_dir):
    p = table(spark, sf_dir, "pages").filter("page_id % 5 <> 0").select(F.concat(F.lit("EP"), text_of("page_id")).alias("id"), pick(F.col("page_id"), "1-2", "", "3").alias("chapter_range"), F.concat(F.lit("a/b:"), text_of("page_id")).alias("topic"), F.col("page_id").alias("ord"))
    files = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("show_ep"), text_of("page_id"), F.lit("_old.mp3")).alias("name"))
    return publish.name_by_chapter(files, p).select("page_id", "new_name")


def q_index_upsert(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    index = n.select("n_name", F.lit("old").alias("entry"))
    return publish.index_upsert(index, n.filter("n_nationkey % 2 = 0").select("n_name", F.lit("new").alias("entry")).unionByName(n.limit(0).select("n_name", F.lit("").alias("entry"))), "n_name")


def q_selected_files(spark, sf_dir):
    f = table(spark, sf_dir, "pages").select("page_id", F.concat(pick(F.col("page_id"), "src/", ".git/", "a/node_modules/b/"), text_of("page_id"), pick(F.col("page_id"), ".py", ".pyc", ".md", ".log")).alias("rel"))
    return publish.select_files(f, [".git", "node_modules"], [".pyc", ".log"], ["DS_Store"]).select("page_id", "rel")


def q_front_matter(spark, sf_dir):
    head = pick(F.col("page_id"), "---\nname: good-name\ndescription: plain\n---\n", "---\nname: Bad Name\ndescription: <b>\n---\n", "no block", "---\nname: ok\ndescription:\n---\n")
    return publish.front_matter_violations(table(spark, sf_dir, "pages").select(text_of("page_id").alias("name"), F.concat(head, F.lit("body")).alias("text")))


def q_index_pages(spark, sf_dir):
    a = _audio(spark, sf_dir).select("show_id", "name", F.col("turn").cast("long").alias("length"), F.lit(75.0).alias("seconds"), F.lit(None).cast("string").alias("notes"))
    return publish.index_page(publish.feed_items(a, "S", "", NOW), "S", "about")


def _candidates(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(text_of("doc_id").alias("bookId"), "source", F.col("text").alias("intro"), F.concat(F.lit("publisher of "), "source").alias("publisher"), pick(F.col("doc_id"), "新", "已在书架", "新").alias("status"))
    return d


def q_new_candidates(spark, sf_dir):
    return catalog.new_candidates(_candidates(spark, sf_dir))


def q_candidate_view(spark, sf_dir):
    return catalog.candidate_view(_candidates(spark, sf_dir)).select("bookId", "intro", "publisher")


def q_best_candidates(spark, sf_dir):
    return catalog.best_candidates(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 3)


def q_search_urls(spark, sf_dir):
    n = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", pick(F.col("p_partkey"), " 100%", "+é/?", "《书》")).alias("t"))
    return n.select("p_partkey", catalog.search_url(F.col("t"), "https://x/search?keyword=").alias("url"))


def _search_answers(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    info = F.struct(text_of("doc_id").alias("bookId"), F.when(F.col("doc_id") % 4 != 0, F.substring("text", 1, 9)).alias("title"), F.lit("named").alias("name"), F.lit("A").alias("author"), (F.col("doc_id") * 7 % 1001).cast("double").alias("newRating"))
    books = F.array_sort(F.collect_list(F.struct(F.col("doc_id").alias("k"), F.struct(info.alias("bookInfo")).alias("b"))))
    return d.groupBy("source").agg(F.to_json(F.struct(F.transform(books, lambda x: x["b"]).alias("books"))).alias("json"))


def q_candidates_of_answers(spark, sf_dir):
    broken = table(spark, sf_dir, "nation").select(F.lit('{"errCode": -1').alias("json"))
    return readers.candidates_of(_search_answers(spark, sf_dir).select("json").unionByName(broken), limit=7).select("bookId", "title", "author", "score")


def q_shelf_of_answers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.to_json(F.struct(F.collect_list(F.struct((F.col("doc_id") % 77).cast("string").alias("bookId"))).alias("books"))).alias("json"))
    return readers.shelf_of(d.select("json").unionByName(d.select(F.lit("oops").alias("json"))))


def q_ci_storage(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("repo", F.concat(F.lit("repo"), text_of("user_id")))
    one = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("name"), (F.col("event_id") * 10).alias("size_in_bytes"), (F.col("event_id") % 3 == 0).alias("expired"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))
    cached = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("key"), F.col("event_id").alias("size_in_bytes"))
    even = F.col("event_id") % 2 == 0
    listing = e.groupBy("repo").agg(F.to_json(F.struct(F.collect_list(F.when(even, one)).alias("artifacts"), F.collect_list(F.when(~even, cached)).alias("actions_caches"))).alias("json"))
    return readers.ci_storage_of(listing).select("repo", "kind", "id", "name", "size_in_bytes", "expired")


def q_line_voices(spark, sf_dir):
    c = script_lines(spark, sf_dir)
    config = pick(F.col("episode"), '"plain"', '{"edge": "e1", "voice": "v", "rate": "+5%"}', '{"voice": "v"}', '{"edge": {"voice": "n", "pitch": "1"}, "rate": "2"}', '{"openai": "o"}')
    voices = c.select("episode", "speaker", config.alias("j")).distinct().select("episode", "speaker", F.parse_json("j").alias("config"))
    lines = c.withColumn("voice", F.when(F.col("line_no") % 4 == 1, "own").when(F.col("line_no") % 4 == 2, " "))
    return dialogue.line_voices(lines, voices, "edge").select("episode", "line_no", "voice", T.sorted_options("options").alias("options"))


def q_render_manifests(spark, sf_dir):
    plan = _planned(spark, sf_dir)
    scripts = table(spark, sf_dir, "conversations").filter("conv_id % 2 = 0").select(F.col("conv_id").alias("episode"), F.concat(F.lit("T"), text_of("conv_id")).alias("title"), F.lit("en").alias("language"), F.lit(0.5).alias("default_gap")).distinct()
    m = dialogue.render_manifest(plan, scripts, "edge")
    files = F.array_join(F.transform("segments", lambda s: s["file"]), ",")
    return m.select("episode_id", "title", "language", "segment_count", "total_chars", "default_gap", files.alias("files"))


def q_outline_links(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(text_of("l_partkey")).alias("needs"), F.collect_set(F.col("l_linenumber").cast("int")).alias("chunks"))
    kp = F.struct(F.concat(F.lit("kp"), text_of("l_orderkey")).alias("id"), F.col("needs").alias("depends_on"), F.col("chunks").alias("source_chunks"))
    thread = F.struct((F.col("l_orderkey") % 10).cast("string").alias("name"), F.array(F.concat(F.lit("kp"), text_of("l_orderkey"))).alias("kp_ids"))
    links = graph.outline_links(li.select(F.array(kp).alias("knowledge_points"), F.array(thread).alias("threads")))
    one = lambda k, a, b: links[k].select(F.lit(k).alias("kind"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    return one("depends_on", "id", "needs").unionByName(one("kp_chunk", "id", "chunk")).unionByName(one("thread_kp", "thread", "id"))


def q_running_feet(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("text", F.concat(F.lit("Volume "), "source", F.lit("\n"), "text", F.lit("\n  Foot of "), "source", F.lit(" \n\n")))
    return pages.running_heads(d, "source")


def q_stripped_pages(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text rlike '[A-Za-z]'").withColumn("text", F.concat(F.lit("Volume "), "source", F.lit("\n"), F.trim("text"), F.lit("\nFoot of "), "source"))
    return pages.strip_running_heads(d, "source").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("sha1"))


def q_volume_chunks(spark, sf_dir):
    n = F.col("n_chars").cast("int")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.concat(F.lit("front START"), F.repeat(F.lit("x"), n), F.lit("M2"), F.repeat(F.lit("y"), n)).alias("text"))
    return chapters.chunk_volumes(d, 5, markers=["M2", "none"], skip_to="START", labels=["one"]).select("book_id", "k", "label", "vol", "start", "end", "chars")


def q_script_shares(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", pick(F.col("doc_id"), "", "привет мир", "你好")).alias("t"))
    s = T.detect_language(F.col("t"))["scripts"]
    return d.select("doc_id", *[F.coalesce(F.try_element_at(s, F.lit(k)), F.lit(0.0)).alias(k) for k in ("latin", "cyrillic", "han")])


def q_chapter_numbers(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 999 + 1).alias("n"))
    digit = lambda n: F.element_at(F.array(*[F.lit(x) for x in " 一二三四五六七八九"]), n.cast("int") + 1)
    h, t, o = F.floor(F.col("n") / 100), F.floor(F.col("n") / 10) % 10, F.col("n") % 10
    said = F.concat(F.when(h > 0, F.concat(digit(h), F.lit("百"))).otherwise(""), F.when((h > 0) & (t == 0) & (o > 0), "零").when(t > 1, F.concat(digit(t), F.lit("十"))).when((t == 1) & (h > 0), "一十").when(t == 1, "十").otherwise(""), F.when(o > 0, digit(o)).otherwise(""))
    return p.select("p_partkey", T.chinese_number(said).cast("int").alias("n"))


def q_repaired_json(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit('{"speaker": "'), "role", pick(F.col("turn"), '": "text": "x"}', '", "text": "x"}', '" :"text":"x"}')).alias("j"))
    return c.select("conv_id", "turn", F.get_json_object(dialogue.repair_script_json(F.col("j")), "$.text").alias("text"))


def q_embedded_images(spark, sf_dir):
    more = F.concat(F.lit('<img alt="" src="/i/'), (F.col("page_id") % 10).cast("string"), F.lit('.png"><img src="data:image/png;base64,AA"><img src="/i/1.png">'))
    return readers.image_urls(table(spark, sf_dir, "pages").select("page_id", F.concat("html", more).alias("html")))


def q_readable_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("html", "[\\u4e00-\\u9fff]", ""), pick(F.col("page_id"), "", "购买后阅读 下一页", "目录", "开通会员")).alias("t"))
    return p.select("page_id", pages.readability(F.col("t")).alias("verdict"))


def q_decoded_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("lang in ('de', 'fr', 'es')")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).when(F.col("doc_id") % 3 == 1, F.encode("text", "UTF-8")).otherwise(F.encode(F.regexp_replace("text", "[^\\x00-\\u00ff]", ""), "ISO-8859-1"))
    return d.select("doc_id", readers.decoded(raw).alias("t")).select("doc_id", F.sha1(F.col("t").cast("binary")).alias("sha1"))


def q_speech_texts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("# **Hi** (laughs) [BGM up] `c` ~~x~~ [l](u) "), F.regexp_replace("text", "[*`~#>\\[\\]()]", "")).alias("t"))
    return c.select("conv_id", "turn", T.clean_for_speech(F.col("t")).alias("t"))


QUERIES = {k[2:]: f for k, f in globals().items() if k.startswith("q_")}

_L = "l AS (SELECT conv_id AS episode, turn AS line_no, role AS speaker, text FROM conversations)"
_AT = lambda number, *values: f"([{', '.join(values)}])[{number} % {len(values)} + 1]"
_AUDIO = "a AS (SELECT conv_id AS show_id, turn, text, 'ep' || turn || CASE WHEN turn % 2 = 0 THEN '_a' ELSE '' END AS stem, 'ep' || turn || CASE WHEN turn % 2 = 0 THEN '_a' ELSE '' END || '.mp3' AS name FROM conversations)"
_EP = "'ep' || lpad(page_id::VARCHAR, greatest(2, length(page_id::VARCHAR))::INTEGER, '0')"
_SPLIT = r"list_filter(string_split(regexp_replace(regexp_replace({0}, '([。！？!?；;…])\s*', '\1' || chr(1), 'g'), '([.!?])\s+([A-Z\"''“])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_matches(x, '\S'))"
_LONG = "这一句话写得非常长因为它要超过四十个汉字的限制所以还得再多写几个字才算真正地超过了那个限制。"

ORACLES = {
    "episode_ids": f"SELECT page_id, {_EP} AS ep FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'ep' || page_id FROM pages WHERE page_id % 2 = 1",
    "page_number_lines": r"""WITH t AS (SELECT doc_id, '- ' || doc_id || ' -' || chr(10) || text || chr(10) || ' ' || doc_id || chr(10) || 'Page 7' AS t FROM documents)
SELECT doc_id, sha1(array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(x, '^[ \t\x{a0}]*[-—–\[(]?[ \t\x{a0}]*[0-9]{1,4}[ \t\x{a0}]*[-—–\])]?[ \t\x{a0}]*$')), chr(10))) AS sha1 FROM t""",
    "short_sections": "SELECT conv_id, turn FROM conversations WHERE length(trim(text, ' ')) >= 30",
    "known_titles": f"""WITH t AS (SELECT conv_id AS book_id, turn AS ord, trim({_AT('turn', "substr(text, 1, 12)", "substr(text, 1, 125)", "'  '", "' Again '")}, ' ') AS title FROM conversations)
SELECT book_id, title, min(ord) AS ord FROM t WHERE title <> '' AND length(title) <= 120 GROUP BY ALL""",
    "folders": "SELECT event_id, 'loose' AS rule FROM events WHERE event_id % 100 = 99 OR event_id % 3 = 0 UNION ALL SELECT event_id, 'strict' FROM events WHERE event_id % 100 = 99",
    "folder_gate": """WITH w AS (SELECT DISTINCT source AS name FROM documents), h AS (SELECT 'src' || (page_id % 9) AS name, min('folder_' || page_id) AS media_id FROM pages GROUP BY 1)
SELECT w.name, media_id, CASE WHEN media_id IS NULL THEN 'create' ELSE 'reuse' END AS action FROM w LEFT JOIN h ON w.name = h.name""",
    "scanned_repos": "SELECT 'repo' || user_id AS repo, count(*) AS total_count FROM events WHERE event_type = 'error' GROUP BY user_id",
    "voice_catalogue": "SELECT (['en-', 'zh-', 'EN-'])[n_nationkey % 3 + 1] || n_name AS \"Locale\", 'v' || n_nationkey AS \"ShortName\" FROM nation WHERE n_nationkey % 3 <> 1",
    "largest_consumer": "SELECT 'repo' || user_id AS repo, sum(event_id)::BIGINT AS bytes FROM events GROUP BY user_id ORDER BY bytes DESC, repo LIMIT 1",
    "file_counts": "SELECT 'seg/' || conv_id AS folder, count(*) AS n_files, count(*) FILTER (turn % 3 = 0 OR length(text) = 0) AS n_empty, sum(CASE WHEN turn % 3 = 0 THEN 0 ELSE length(text) END)::BIGINT AS bytes FROM conversations GROUP BY conv_id",
    "http_outcomes": "SELECT event_id, (['ok', 'gone', 'skip', 'skip', 'token', 'error'])[event_id % 6 + 1] AS outcome FROM events",
    "scores": "WITH r AS (SELECT p_partkey, p_partkey * 7 % 1001 AS r FROM part) SELECT p_partkey, nullif(CASE WHEN r > 100 THEN round_even(r / 10.0::DOUBLE, 1) ELSE r::DOUBLE END, 0) AS score FROM r",
    "key_age": "WITH a AS (SELECT event_id, date_diff('day', ts::DATE - (event_id % 120)::INTEGER, DATE '2024-02-01') AS age FROM events) SELECT event_id, age::INTEGER AS age_days, age > 80 AS remind FROM a",
    "script_rules": f"""WITH s AS (SELECT conv_id AS k, {_AT('conv_id', "'ep'", "'ep '", "'e-'")} || conv_id AS episode_id, list(CASE WHEN (turn + conv_id) % 3 = 2 THEN '' ELSE text END) AS t, list((turn + conv_id) % 4 = 3) AS p FROM conversations GROUP BY conv_id)
SELECT episode_id, 'episode_id' AS rule FROM s WHERE k % 3 = 1 UNION ALL SELECT episode_id, 'title' FROM s WHERE k % 2 = 1 UNION ALL SELECT episode_id, 'engine' FROM s WHERE k % 3 = 1
UNION ALL SELECT episode_id, 'default_gap' FROM s WHERE k % 4 = 1 UNION ALL SELECT episode_id, 'voices' FROM s WHERE k % 3 = 1 UNION ALL SELECT episode_id, 'lines' FROM s WHERE k % 11 = 0
UNION ALL SELECT episode_id, 'pause_after' FROM s WHERE k % 11 <> 0 AND list_bool_or(p) UNION ALL SELECT episode_id, 'line_text' FROM s WHERE k % 11 <> 0 AND list_contains(t, '')""",
    "unknown_speakers": "SELECT conv_id AS episode, turn AS line_no, role AS speaker FROM conversations c WHERE NOT (role = 'user' OR conv_id % 2 = 0)",
    "line_rules": f"""WITH {_L}, t AS (SELECT episode, line_no, CASE line_no % 6 WHEN 0 THEN text WHEN 1 THEN text || ' It grew by 85% since.' WHEN 2 THEN text || '{_LONG}' WHEN 3 THEN 'um uh well 嗯 um' WHEN 4 THEN ' ' ELSE text || '**bold** [a](b)' END AS t FROM l),
s AS (SELECT *, length(t) AS n, {_SPLIT.format('t')} AS p FROM t), m AS (SELECT episode, line_no, t, n, regexp_matches(t, '[\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{9fff}}]') AS u, CASE WHEN len(p) = 0 THEN [t] ELSE p END AS p FROM s),
w AS (SELECT *, list_max(list_transform(p, lambda x: length(trim(x, ' ')))) AS c, list_max(list_transform(p, lambda x: len(regexp_split_to_array(trim(x, ' '), '\\s+')))) AS w FROM m),
r AS (SELECT episode, line_no, unnest([{{'r': 'empty_text', 'h': trim(t, ' ') = '', 'd': n}}, {{'r': 'line_short', 'h': trim(t, ' ') <> '' AND n < 20, 'd': n}}, {{'r': 'line_long', 'h': n > 120, 'd': n}},
  {{'r': 'sentence_long', 'h': CASE WHEN u THEN c > 40 ELSE w > 25 END, 'd': CASE WHEN u THEN c ELSE w END}}, {{'r': 'markdown', 'h': line_no % 6 = 5 OR regexp_matches(t, '\\*\\*|^#{{1,6}} |`|\\]\\('), 'd': n}},
  {{'r': 'numeric_share', 'h': regexp_matches(t, '[0-9]+ ?[%/] ?[0-9]*'), 'd': n}}, {{'r': 'fillers', 'h': len(regexp_extract_all(lower(t), '\\b(um|uh|well|you know|i mean)\\b|嗯|呃|那个')) * 100 > 2 * n, 'd': len(regexp_extract_all(lower(t), '\\b(um|uh|well|you know|i mean)\\b|嗯|呃|那个'))}}]) AS v FROM w)
SELECT episode, line_no, v.r AS rule, v.d::INTEGER AS detail FROM r WHERE v.h""",
    "banned_openings": "SELECT conv_id AS episode, (['欢迎收听本期节目', '大家好我是', '', '', '今天我们要讲的是'])[conv_id % 5 + 1] AS opening FROM conversations WHERE turn = 0 AND conv_id % 5 IN (0, 1, 4)",
    "suggested_pauses": f"""WITH {_L}, n AS (SELECT *, lead(line_no) OVER w AS following, lead(line_no % 5 = 3) OVER w AS opens FROM l WINDOW w AS (PARTITION BY episode ORDER BY line_no)),
r AS (SELECT episode, line_no, CASE WHEN following IS NULL THEN 'end' WHEN opens THEN 'topic switch' WHEN line_no % 3 > 0 OR regexp_matches(trim(text, ' '), '[?？]$') THEN 'question' END AS reason FROM n)
SELECT *, CASE reason WHEN 'end' THEN 1.2 WHEN 'topic switch' THEN 1.5 ELSE 0.8 END::DOUBLE AS pause_s FROM r WHERE reason IS NOT NULL""",
    "explicit_pauses": f"""WITH {_L}, p AS (SELECT *, (line_no % 3 = 1)::INT * 700 + (line_no % 3 = 2)::INT * 5 AS after, (line_no % 4 = 1)::INT * 900 AS before FROM l),
g AS (SELECT *, row_number() OVER w AS k, CASE WHEN lag(after) OVER w > 0 THEN lag(after) OVER w WHEN speaker IS DISTINCT FROM lag(speaker) OVER w THEN 630 ELSE 350 END AS base FROM p WINDOW w AS (PARTITION BY episode ORDER BY line_no)),
h AS (SELECT *, CASE WHEN k = 1 THEN 0 WHEN greatest(base, before) > 10 THEN greatest(base, before) ELSE 0 END::BIGINT AS gap_ms FROM g),
e AS (SELECT *, (sum(gap_ms + 1000) OVER (PARTITION BY episode ORDER BY line_no))::BIGINT AS end_ms FROM h) SELECT episode, line_no, gap_ms, end_ms - 1000 AS start_ms, end_ms FROM e""",
    "target_fit": """WITH d AS (SELECT doc_id, doc_id % 9 + 1 AS m, len(string_split(text, ' ')) AS n, CASE WHEN lang = 'en' THEN 150 WHEN lang IN ('es', 'fr', 'de') THEN 140 END AS lo, CASE WHEN lang = 'en' THEN 170 WHEN lang IN ('es', 'fr', 'de') THEN 160 END AS hi FROM documents)
SELECT doc_id, lo * m AS low_units, hi * m AS high_units, n BETWEEN lo * m AND hi * m AS fits FROM d""",
    "episode_load": """WITH p AS (SELECT p_partkey, p_size % 2 = 0 AS proven FROM part WHERE p_partkey * 2 % 3 <> 0)
SELECT l_orderkey AS episode, count(*) AS n_points, count(*) FILTER (proven IS NULL) AS n_unknown, count(*) FILTER (NOT proven) AS n_without_evidence, CASE WHEN count(*) > 5 THEN 'overloaded' WHEN count(*) < 3 THEN 'thin' ELSE 'fits' END AS verdict
FROM lineitem LEFT JOIN p ON l_partkey = p_partkey GROUP BY l_orderkey""",
    "episode_fields": """WITH c AS (SELECT conv_id || '-' || turn AS id, turn, text FROM conversations) SELECT id, 'title' AS field FROM c WHERE turn % 3 = 1 UNION ALL SELECT id, 'chapter_range' FROM c WHERE turn % 4 = 1 UNION ALL SELECT id, 'topic' FROM c WHERE trim(text, ' ') = ''""",
    "script_files": f"""WITH f AS (SELECT page_id, {_EP} || ([ '.script.json', '.json', '.script.json'])[page_id % 3 + 1] AS name FROM pages)
SELECT name, 'name' AS rule FROM f WHERE page_id % 3 = 1 UNION ALL SELECT name, 'id' FROM f WHERE page_id % 3 = 2""",
    "segments_ready": """WITH p AS (SELECT conv_id AS episode, count(*) FILTER ((turn + conv_id) % 2 = 0) AS n FROM conversations WHERE conv_id % 3 = 0 GROUP BY conv_id), e AS (SELECT DISTINCT conv_id AS episode FROM conversations)
SELECT e.episode, coalesce(n, 0) AS n_problems, coalesce(n, 0) = 0 AS ready FROM e LEFT JOIN p ON e.episode = p.episode""",
    "extraction_checks": """WITH d AS (SELECT doc_id AS id, n_chars * (CASE WHEN doc_id % 3 = 1 THEN 20 ELSE 1 END) AS declared, length(text) AS chars FROM documents)
SELECT id, 'length' AS rule FROM d WHERE coalesce(chars::DOUBLE / nullif(declared, 0) NOT BETWEEN 0.1 AND 10, TRUE) UNION ALL SELECT id, 'images' FROM d WHERE id % 4 = 0 UNION ALL SELECT id, 'empty_chapter' FROM d WHERE id % 5 = 0""",
    "empty_segment_lines": f"WITH {_L} SELECT * FROM l WHERE line_no % 4 = 2",
    "episode_titles": f"""SELECT {_EP} AS ep, CASE WHEN page_id % 3 = 0 AND page_id % 2 = 0 THEN 'S' || page_id WHEN page_id % 4 = 1 THEN '' WHEN page_id % 3 = 1 THEN 'T' || page_id ELSE 'E' || page_id END AS title FROM pages""",
    "selected_episodes": f"SELECT {_EP} AS id FROM pages WHERE page_id IN (7, 12, 240)",
    "file_order": f"""WITH {_AUDIO} SELECT show_id, name, (row_number() OVER (PARTITION BY show_id ORDER BY name))::INTEGER AS place, (row_number() OVER (PARTITION BY show_id ORDER BY turn, name))::INTEGER AS numeric_place FROM a""",
    "tracks": f"WITH {_AUDIO} SELECT show_id, name, (row_number() OVER (PARTITION BY show_id ORDER BY name))::INTEGER AS track, count(*) OVER (PARTITION BY show_id) AS n_tracks FROM a",
    "framed_episodes": """WITH e AS (SELECT DISTINCT conv_id AS episode FROM conversations), f AS (SELECT conv_id AS episode, 1 AS k, turn AS part, printf('seg_%04d', turn + 1) AS file FROM conversations UNION ALL SELECT episode, 0, 0, 'intro' FROM e WHERE episode % 2 = 0 UNION ALL SELECT episode, 2, 0, 'outro' FROM e WHERE episode % 3 = 0)
SELECT episode, (row_number() OVER (PARTITION BY episode ORDER BY k, part))::INTEGER AS seq, file FROM f""",
    "notes": f"WITH {_AUDIO} SELECT show_id, name, CASE WHEN turn % 2 = 0 THEN text END AS notes FROM a",
    "names_by_chapter": """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'show_ep' || page_id || '_old.mp3' ELSE 'ep' || page_id || (['_1-2', '', '_3'])[page_id % 3 + 1] || '_a b ' || page_id || '.mp3' END AS new_name FROM pages""",
    "index_upsert": "SELECT n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS entry FROM nation",
    "selected_files": "WITH f AS (SELECT page_id, (['src/', '.git/', 'a/node_modules/b/'])[page_id % 3 + 1] || page_id || (['.py', '.pyc', '.md', '.log'])[page_id % 4 + 1] AS rel FROM pages) SELECT * FROM f WHERE page_id % 3 = 0 AND page_id % 2 = 0",
    "front_matter": "SELECT page_id::VARCHAR AS name, unnest((([[], ['name', 'description'], ['block'], ['description']])[page_id % 4 + 1])::VARCHAR[]) AS rule FROM pages",
    "index_pages": f"""WITH {_AUDIO}, b AS (SELECT *, row_number() OVER (PARTITION BY show_id ORDER BY name) AS k FROM a),
c AS (SELECT show_id, k, chr(10) || '## ' || k || '. ' || stem || chr(10) || chr(10) || '- 音频: ' || name || ' · 1:15 · ' || printf('%.1f', turn / 1048576.0) || ' MB' || chr(10) AS entry FROM b)
SELECT show_id, '# S' || chr(10) || chr(10) || '> about' || chr(10) || chr(10) || '共 ' || count(*) || ' 集' || chr(10) || string_agg(entry, '' ORDER BY k) AS markdown FROM c GROUP BY show_id""",
    "new_candidates": "SELECT count(*) AS n_candidates, count(*) FILTER (doc_id % 3 <> 1) AS n_new FROM documents",
    "candidate_view": "SELECT doc_id::VARCHAR AS \"bookId\", substr(text, 1, 70) AS intro, substr('publisher of ' || source, 1, 12) AS publisher FROM documents",
    "best_candidates": "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3",
    "search_urls": "SELECT p_partkey, 'https://x/search?keyword=' || url_encode(p_name || ([' 100%', '+é/?', '《书》'])[p_partkey % 3 + 1]) AS url FROM part",
    "candidates_of_answers": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, doc_id * 7 % 1001 AS s FROM documents)
SELECT doc_id::VARCHAR AS "bookId", coalesce(CASE WHEN doc_id % 4 <> 0 AND trim(substr(text, 1, 9), ' ') <> '' THEN substr(text, 1, 9) END, 'named') AS title, 'A' AS author, nullif(CASE WHEN s > 100 THEN round_even(s / 10.0::DOUBLE, 1) ELSE s::DOUBLE END, 0) AS score FROM r WHERE k <= 7""",
    "shelf_of_answers": "SELECT DISTINCT (doc_id % 77)::VARCHAR AS \"bookId\" FROM documents",
    "ci_storage": "SELECT 'repo' || user_id AS repo, CASE WHEN event_id % 2 = 0 THEN 'artifact' ELSE 'cache' END AS kind, event_id AS id, event_type AS name, event_id * (CASE WHEN event_id % 2 = 0 THEN 10 ELSE 1 END) AS size_in_bytes, CASE WHEN event_id % 2 = 0 THEN event_id % 3 = 0 END AS expired FROM events",
    "line_voices": """SELECT conv_id AS episode, turn AS line_no, CASE WHEN turn % 4 = 1 THEN 'own' ELSE (['plain', 'e1', 'v', 'n', NULL])[conv_id % 5 + 1] END AS voice, (['{}', '{"rate": "+5%"}', '{}', '{"pitch": "1", "rate": "2"}', '{}'])[conv_id % 5 + 1] AS options FROM conversations""",
    "render_manifests": f"""WITH {_LINES} SELECT episode::VARCHAR AS episode_id, CASE WHEN episode % 2 = 0 THEN 'T' || episode ELSE '' END AS title, CASE WHEN episode % 2 = 0 THEN 'en' ELSE '' END AS language, count(*)::INTEGER AS segment_count,
sum(chars)::INTEGER AS total_chars, CASE WHEN episode % 2 = 0 THEN 0.5 ELSE 0.35 END::DOUBLE AS default_gap, string_agg(printf('seg_%04d', line_no + 1), ',' ORDER BY line_no) AS files FROM p GROUP BY episode""",
    "outline_links": """SELECT 'depends_on' AS kind, 'kp' || l_orderkey AS a, l_partkey::VARCHAR AS b FROM lineitem GROUP BY ALL UNION ALL SELECT 'kp_chunk', 'kp' || l_orderkey, l_linenumber::VARCHAR FROM lineitem GROUP BY ALL
UNION ALL SELECT DISTINCT 'thread_kp', (l_orderkey % 10)::VARCHAR, 'kp' || l_orderkey FROM lineitem""",
    "running_feet": """WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) >= 6) SELECT source AS book, 'head' AS kind, 'Volume ' || source AS line, n FROM c UNION ALL SELECT source, 'foot', 'Foot of ' || source, n FROM c""",
    "stripped_pages": """WITH d AS (SELECT doc_id, source, trim(text, ' ') AS t, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE regexp_matches(text, '[A-Za-z]'))
SELECT doc_id, sha1(CASE WHEN n >= 6 THEN t ELSE 'Volume ' || source || chr(10) || t || chr(10) || 'Foot of ' || source END) AS sha1 FROM d""",
    "volume_chunks": """WITH b AS (SELECT doc_id AS book_id, n_chars AS n, 6 AS base FROM documents), v AS (SELECT *, 1 AS vol, 0 AS low, 5 + n AS high, 3 AS parts FROM b UNION ALL SELECT *, 2, 5 + n, 5 + n + 2 + n, 2 FROM b),
c AS (SELECT *, unnest(range(parts)) AS j FROM v), r AS (SELECT *, low + (high - low) * j // parts AS a, low + (high - low) * (j + 1) // parts AS z FROM c)
SELECT book_id, (row_number() OVER (PARTITION BY book_id ORDER BY vol, j))::INTEGER AS k, CASE vol WHEN 1 THEN 'one' ELSE '2' END AS label, vol::INTEGER AS vol, (a + base)::INTEGER AS "start", (z + base)::INTEGER AS "end", (z - a)::INTEGER AS chars FROM r""",
    "script_shares": """WITH t AS (SELECT doc_id, text || (['', 'привет мир', '你好'])[doc_id % 3 + 1] AS t FROM documents), c AS (SELECT doc_id, length(regexp_replace(t, '[^A-Za-zÀ-ɏ]', '', 'g')) AS l, length(regexp_replace(t, '[^Ѐ-ӿ]', '', 'g')) AS c, length(regexp_replace(t, '[^一-鿿]', '', 'g')) AS h FROM t)
SELECT doc_id, l::DOUBLE / greatest(1, l + c + h) AS latin, c::DOUBLE / greatest(1, l + c + h) AS cyrillic, h::DOUBLE / greatest(1, l + c + h) AS han FROM c""",
    "chapter_numbers": "SELECT p_partkey, (p_partkey % 999 + 1)::INTEGER AS n FROM part",
    "repaired_json": "SELECT conv_id, turn, 'x' AS text FROM conversations",
    "embedded_images": """WITH o AS (SELECT page_id AS id, unnest(regexp_extract_all(html, '<img[^>]*\\ssrc="([^"]+)"', 1)) AS url FROM pages UNION ALL SELECT page_id, '/i/' || (page_id % 10) || '.png' FROM pages UNION ALL SELECT page_id, '/i/1.png' FROM pages) SELECT DISTINCT * FROM o WHERE NOT starts_with(url, 'data:')""",
    "readable_pages": "SELECT page_id, (['异常', '试读墙', '可读', '试读墙'])[page_id % 4 + 1] AS verdict FROM pages",
    "decoded_texts": "SELECT doc_id, sha1(CASE WHEN doc_id % 3 = 2 THEN regexp_replace(text, '[^\\x{00}-\\x{ff}]', '', 'g') ELSE text END) AS sha1 FROM documents WHERE lang IN ('de', 'fr', 'es')",
    "speech_texts": """WITH t AS (SELECT conv_id, turn, regexp_replace(text, '[*`~#>\\[\\]()]', '', 'g') AS t FROM conversations) SELECT conv_id, turn, trim('Hi … c x l ' || trim(regexp_replace(t, '\\s+', ' ', 'g'), ' '), ' ') AS t FROM t""",
}
