"""Schemas of the entities, as DDL."""

LANGUAGE = "struct<code:string,name:string,confidence:double,scripts:map<string,double>,forced:boolean>"
CHAPTER = "struct<index:int,title:string,start:int,end:int,chars:int>"
CHUNK = "struct<id:int,file:string,chapter_index:int,chapter_title:string,part:int,chars:int,preview:string,parts_in_chapter:int>"
LINE = "struct<speaker:string,text:string,pause_after:double,chapter:string,voice:string,tts_opts:map<string,string>>"
SEGMENT = "struct<index:int,speaker:string,voice:string,text:string,chars:int,hash:string,file:string,pause_after:double,chapter:string,cached:boolean>"
POINT = "struct<id:string,name:string,type:string,one_liner:string,explanation:string,evidence:array<string>,counterintuitive:string,quotes:array<string>,actionable:array<string>,source_chunks:array<int>,weight:int,depends_on:array<string>>"

BOOK = f"source_file string, format string, title string, author string, language {LANGUAGE}, total_chars int, est_read_minutes int, chapter_count int, chapters array<{CHAPTER}>, text_file string"
MANIFEST = f"book_title string, language string, total_chars int, chunk_count int, target_chars int, batch_count int, reading_batches array<struct<batch:int,chunks:array<int>>>, chunks array<{CHUNK}>"
NOVEL_CHUNK = "k int, label string, vol int, start int, end int, chars int"
SCRIPT = f"episode_id string, title string, language string, engine string, default_gap double, voices variant, lines array<{LINE}>"
RENDER_MANIFEST = f"episode_id string, title string, language string, engine string, segment_count int, total_chars int, default_gap double, segments array<{SEGMENT}>"
EPISODE = "id string, title string, chapter_range string, topic string, core_question string, hook string, takeaway string, kp_ids array<string>, target_minutes int"
OUTLINE = f"book struct<title:string,author:string,language:string,type:string>, thesis string, why_it_matters string, critique string, not_covered string, knowledge_points array<{POINT}>, threads array<struct<name:string,kp_ids:array<string>,narrative:string>>"
CANDIDATE = "bookId string, title string, author string, publisher string, price double, score double, label string, readerLink string, intro string, status string"
KB_ITEM = "media_id string, media_type string, name string, title string, content_count string"
CI_STORAGE = "repo string, kind string, id bigint, name string, size_in_bytes bigint, expired boolean, created_at timestamp"
