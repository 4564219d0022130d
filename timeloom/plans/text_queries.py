"""Queries over text: predicates, parsing, repairing and assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.functions import scalars
from timeloom.operators import assemble, select, store, text
from timeloom.plans.inputs import FRAMES, SEGMENTS, STRIP, frames, hms_sql, segments
from timeloom.session import load, spread
from timeloom.sources import readers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_ODD = "CASE doc_id % 9 WHEN 0 THEN '请订阅' || text WHEN 1 THEN '  感谢观看 ' || text WHEN 2 THEN '字幕由某某提供' WHEN 3 THEN '   ' ELSE text END"


@_query(f"SELECT doc_id FROM documents WHERE NOT ({STRIP.format(_ODD)} = '' OR regexp_matches({STRIP.format(_ODD)}, '^请订阅|^感谢观看|^字幕由.*提供|^明镜|^点点栏目|^MING PAO|^由.*翻译'))")
def f1_filter(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").withColumn("t", F.expr(_ODD)).where(~scalars.is_hallucination(F.col("t"))).select("doc_id")


_ANCHOR = "CASE turn % 4 WHEN 0 THEN text || ' Look At This' WHEN 1 THEN text || ' 如图' WHEN 2 THEN 'PAY ATTENTION ' || text ELSE text END"


@_query(f"SELECT conv_id, turn FROM conversations WHERE regexp_matches({_ANCHOR}, '{'|'.join(scalars.ANCHORS)}', 'i')")
def f6_anchor(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "conversations").withColumn("t", F.expr(_ANCHOR)).where(scalars.is_anchor(F.col("t"))).select("conv_id", "turn")


_CODE = """CASE turn % 6 WHEN 0 THEN '# only' || chr(10) || '// comments here' WHEN 1 THEN 'x = 1' WHEN 2 THEN 'print(1) # TODO later on' WHEN 3 THEN 'foo(a, ...)  # long enough' WHEN 4 THEN 'value = compute(1, 2)' || chr(10) || '# done' ELSE '  ' END"""


@_query(f"""WITH c AS (SELECT conv_id, turn, {STRIP.format(_CODE)} AS s FROM conversations)
SELECT conv_id, turn, length(s) < 10 OR len(list_filter(string_split(s, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '#') AND NOT starts_with(trim(x), '//'))) = 0
 OR {' OR '.join(f"contains(s, '{p}')" for p in scalars.PLACEHOLDERS)} AS placeholder FROM c""")
def f7_placeholder(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "conversations").select("conv_id", "turn", scalars.is_placeholder(F.expr(_CODE)).alias("placeholder"))


@_query(f"SELECT conv_id, turn FROM conversations WHERE length({STRIP.format('text')}) >= 80")
def f9_short_response(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "conversations").where(F.length(scalars.strip(F.col("text"))) >= 80).select("conv_id", "turn")


@_query("SELECT page_id, split_part(list_last(string_split(regexp_replace(url, '/+$', ''), '/')), '?', 1) AS url_key FROM pages")
def r7_url_key(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", scalars.url_key(F.col("url")).alias("url_key"))


_MEDIA = "CASE page_id % 3 WHEN 0 THEN '' || page_id WHEN 1 THEN 'https://x.example/video/' || (page_id * 7) || '?a=1' ELSE url END"


@_query(f"SELECT page_id, CASE WHEN regexp_full_match(u, '[0-9]+') THEN u ELSE nullif(regexp_extract(u, '/video/([0-9]+)', 1), '') END AS media_id FROM (SELECT page_id, {_MEDIA} AS u FROM pages)")
def r8_media_id(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", scalars.media_id(F.expr(_MEDIA)).alias("media_id"))


@_query("SELECT page_id, array_to_string(list_slice(string_split(replace('c:\\work\\' || page_id || '\\frames/' || page_id || '.jpg', '\\', '/'), '/'), -2, -1), '/') AS rel FROM pages")
def r5_relpath(spark: SparkSession, d: str) -> DataFrame:
    p = F.concat(F.lit("c:\\work\\"), "page_id", F.lit("\\frames/"), "page_id", F.lit(".jpg"))
    return load(spark, d, "pages").select("page_id", scalars.relative_path(p).alias("rel"))


@_query("SELECT doc_id, left(text, 200) AS head, right(text, 100) AS tail FROM documents")
def r6_truncate(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.left("text", F.lit(200)).alias("head"), F.right("text", F.lit(100)).alias("tail"))


@_query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def r9_json_field(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


_DETAIL = """CASE page_id % 3 WHEN 0 THEN '{"aweme_detail":{"desc":"t' || page_id || '","aweme_id":"' || page_id || '","author":{"nickname":"n"},"video":{"duration":' || (page_id * 1000 + 500) || ',"play_addr":{"url_list":["","ftp://x","http://a/' || page_id || '"]}}}}' WHEN 1 THEN '{"aweme_detail":{"desc":"only"}}' ELSE '{}' END"""


@_query(f"""SELECT page_id, json_extract_string(j, '$.aweme_detail.video.play_addr.url_list[2]') AS url, coalesce(json_extract_string(j, '$.aweme_detail.desc'), '') AS title,
 coalesce(json_extract_string(j, '$.aweme_detail.author.nickname'), '') AS uploader, coalesce(CAST(json_extract(j, '$.aweme_detail.video.duration') AS DOUBLE), 0) / 1000 AS duration, json_extract_string(j, '$.aweme_detail.aweme_id') AS media_id
 FROM (SELECT page_id, {_DETAIL} AS j FROM pages)""")
def r9_nested_json(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", *(c.alias(n) for n, c in readers.navigate(F.expr(_DETAIL)).items()))


@_query("SELECT page_id, CASE WHEN contains(lower(url), '.org') THEN 'second' ELSE 'first' END AS site FROM pages")
def s3_router(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", scalars.site(F.col("url"), ".org", "second", "first").alias("site"))


_COOKIE = """CASE page_id % 4 WHEN 0 THEN '# comment' WHEN 1 THEN '.Site.example' || chr(9) || 'a' || chr(9) || 'b' || chr(9) || 'c' || chr(9) || 'd' || chr(9) || 'n' || page_id || chr(9) || 'v' || page_id WHEN 2 THEN 'short' || chr(9) || 'row' ELSE 'other' || chr(9) || 'a' || chr(9) || 'b' || chr(9) || 'c' || chr(9) || 'd' || chr(9) || 'n' || chr(9) || 'v' END"""


@_query("SELECT string_agg('n' || page_id || '=v' || page_id, '; ' ORDER BY page_id) AS header FROM pages WHERE page_id % 4 = 1")
def s7_cookies(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "pages").select(F.col("page_id").alias("pos"), F.expr(_COOKIE).alias("value"))
    return readers.cookie_header(lines, "site")


@_query("SELECT CAST(page_id AS VARCHAR) || '.jpg' AS name FROM pages WHERE page_id % 3 <> 0")
def s13_prune(spark: SparkSession, d: str) -> DataFrame:
    listing = load(spark, d, "pages").select(F.concat(F.col("page_id"), F.lit(".jpg")).alias("name"), (F.col("page_id") % 3 == 0).alias("k"))
    return readers.files_to_prune(listing.select("name"), listing.where("k").select("name"))




@_query(f"""WITH {SEGMENTS} SELECT conv_id AS video_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seg_idx,
 turn * 3600.0::DOUBLE + turn + 0.5::DOUBLE AS "start", turn * 3600.0::DOUBLE + turn + 1 AS "end", turn || ' ' || {STRIP.format("replace(text, chr(10), ' ')")} AS text FROM conversations""")
def t1_vtt(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "conversations")
    stamp = F.format_string("%02d:00:%02d.500 --> %02d:00:%02d.000", "turn", "turn", "turn", F.col("turn") + 1)
    block = F.concat(F.col("turn"), F.lit("\n"), stamp, F.lit("\n"), F.replace("text", F.lit("\n"), F.lit(" ")))
    lists = c.groupBy(F.col("conv_id").alias("video_id")).agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("x"))
    files = lists.select("video_id", F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("x", lambda b: b["b"]), "\n\n")).alias("value"))
    return text.parse_captions(files).withColumn("seg_idx", F.col("seg_idx").cast("int"))




@_query(f"""WITH {SEGMENTS}, st AS (SELECT video_id, seg_idx, CAST(floor("start" * 3) AS BIGINT) AS x FROM segments), both_ AS (
 SELECT video_id, seg_idx, 0 AS p, x  AS at_ FROM st UNION ALL SELECT video_id, seg_idx, 1, x + 40 FROM st),
fixed AS (SELECT b.*, CASE WHEN EXISTS (SELECT 1 FROM segments s WHERE s.video_id = b.video_id AND b.at_ >= s."start" - 5 AND b.at_ <= greatest(s."start", s."end") + 5) THEN CAST(at_ AS DOUBLE)
  ELSE (SELECT min_by(s."start", [abs(s."start" - b.at_), s."start"]) FROM segments s WHERE s.video_id = b.video_id) END AS now_ FROM both_ b)
SELECT video_id, seg_idx, 'a [' || max({hms_sql('now_')}) FILTER (p = 0) || '] b [' || max({hms_sql('now_')}) FILTER (p = 1) || '] c' AS repaired FROM fixed GROUP BY video_id, seg_idx""")
def t2_stamps(spark: SparkSession, d: str) -> DataFrame:
    seg = segments(spark, d)
    x = F.floor(F.col("start") * 3)
    md = F.concat(F.lit("a ["), scalars.hms(x), F.lit("] b ["), scalars.hms(x + 40), F.lit("] c"))
    s = seg.select("video_id", "seg_idx", md.alias("md"))
    return text.repair_stamps(s, seg, "video_id", "seg_idx", "md").select("video_id", "seg_idx", "repaired")


TYPES = ["code", "slide", "diagram", "ui", "talking_head", "transition"]
_REPLY = """CASE turn % 5 WHEN 0 THEN 'type: Code' || chr(10) || 'HAS_TEXT: Yes' || chr(10) || 'BRIEF:  ' || text WHEN 1 THEN 'TYPE: foo' || chr(10) || 'has_text: no' WHEN 2 THEN 'TYPE: ui' || chr(10) || 'TYPE: slide' || chr(10) || 'HAS_TEXT: 1' WHEN 3 THEN 'nothing' ELSE 'TYPE：code' END"""


@_query(f"""SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'code' WHEN 2 THEN 'slide' ELSE 'transition' END AS type, turn % 5 IN (0, 2) AS has_text,
 CASE WHEN turn % 5 = 0 THEN left({STRIP.format("split_part(text, chr(10), 1)")}, 60) ELSE '' END AS brief FROM conversations""")
def t3_classification(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "conversations").withColumn("reply", F.expr(_REPLY))
    return text.parse_classification(c, "reply", TYPES).select("conv_id", "turn", "type", "has_text", "brief")


_JSON = """CASE event_id % 4 WHEN 0 THEN 'Here: ```json' || chr(10) || '{"a":' || event_id || ',}' || chr(10) || '``` ok' WHEN 1 THEN 'x {"a": ' || event_id || ', // note' || chr(10) || ' "b": "t"} y' WHEN 2 THEN '{''a'': ' || event_id || '}' ELSE 'no json' END"""


@_query("SELECT event_id, CASE WHEN event_id % 4 < 3 THEN event_id END AS a, CASE WHEN event_id % 4 = 1 THEN 't' END AS b FROM events")
def t4_json(spark: SparkSession, d: str) -> DataFrame:
    j = text.lenient_json(F.expr(_JSON), "a long, b string")
    return load(spark, d, "events").select("event_id", j["a"].alias("a"), j["b"].alias("b"))


_MD = """'# T' || turn || chr(10) || chr(10) || 'First line of ' || conv_id || '.' || chr(10) || '![a](frames/f' || (turn % 3) || '.jpg)' || chr(10) || '```python' || chr(10) || 'value_' || (conv_id % 5) || ' = compute(' || turn || ')' || chr(10) || '```' || chr(10) || CASE WHEN turn % 2 = 0 THEN '### 本节完整代码' || chr(10) || '```js' || chr(10) || 'let total = ' || (conv_id % 3) || ' + 1;' || chr(10) || '```' || chr(10) ELSE '### 本节完整代码' || chr(10) || '```' || chr(10) || '# TODO' || chr(10) || '```' || chr(10) END || '## Next' || chr(10)"""


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "conversations").select("conv_id", "turn", F.expr(_MD).alias("md"))


@_query("""SELECT conv_id, turn, 'python' AS lang, 'value_' || (conv_id % 5) || ' = compute(' || turn || ')' AS code FROM conversations
UNION ALL SELECT conv_id, turn, 'js', 'let total = ' || (conv_id % 3) || ' + 1;' FROM conversations WHERE turn % 2 = 0""")
def t5_code(spark: SparkSession, d: str) -> DataFrame:
    return _markdown(spark, d).select("conv_id", "turn", F.explode(text.code_blocks(F.col("md"))).alias("b")).select("conv_id", "turn", "b.lang", "b.code")


@_query("SELECT conv_id, turn, 'let total = ' || (conv_id % 3) || ' + 1;' AS code FROM conversations WHERE turn % 2 = 0")
def t6_full_code(spark: SparkSession, d: str) -> DataFrame:
    return _markdown(spark, d).select("conv_id", "turn", F.explode(text.code_blocks(text.full_code_section(F.col("md")))).alias("b")).select("conv_id", "turn", "b.code")


@_query(f"""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN regexp_replace({_MD}, '\\s+$', '') || chr(10) ELSE replace({_MD}, '### 本节完整代码' || chr(10) || '```' || chr(10) || '# TODO' || chr(10) || '```' || chr(10) || '## Next' || chr(10), chr(10) || '## Next' || chr(10)) END AS md FROM conversations""")
def t7_strip_empty(spark: SparkSession, d: str) -> DataFrame:
    return _markdown(spark, d).select("conv_id", "turn", text.drop_empty_full_code(F.col("md")).alias("md"))


@_query("SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'f2.jpg' ELSE '' END AS dropped FROM conversations")
def t8_images(spark: SparkSession, d: str) -> DataFrame:
    _, names = text.drop_foreign_images(F.col("md"), F.array(F.lit("f0.jpg"), F.lit("f1.jpg")))
    return _markdown(spark, d).select("conv_id", "turn", F.array_join(names, ",").alias("dropped"))


@_query("SELECT conv_id, turn, '# T' || turn AS heading, 'First line of ' || conv_id || '.' AS first_para FROM conversations")
def t9_skeleton(spark: SparkSession, d: str) -> DataFrame:
    return _markdown(spark, d).select("conv_id", "turn", text.skeleton(F.col("md")).alias("s")).select("conv_id", "turn", "s.heading", "s.first_para")


@_query("""WITH b AS (SELECT conv_id, turn AS pos, CASE WHEN turn % 2 = 0 THEN 'let total = ' || (conv_id % 3) || ' + 1;' ELSE 'value_' || (conv_id % 5) || ' = compute(' || turn || ')' END AS code FROM conversations)
SELECT conv_id, min(pos) AS pos, code FROM b GROUP BY conv_id, code""")
def t10_code_collection(spark: SparkSession, d: str) -> DataFrame:
    s = _markdown(spark, d).select("conv_id", F.col("turn").alias("section_pos"), "md")
    return assemble.collected_code(s, "conv_id").select("conv_id", "pos", "code")


_TEN = """WITH m AS (SELECT conv_id, turn, rtrim({md}, chr(10)) AS md, turn % 4 <> 3 AS done,
  CASE WHEN turn % 2 = 0 THEN 'js' ELSE 'python' END AS lang, CASE WHEN turn % 2 = 0 THEN 'let total = ' || (conv_id % 3) || ' + 1;' ELSE 'value_' || (conv_id % 5) || ' = compute(' || turn || ')' END AS code FROM conversations),
c AS (SELECT conv_id, string_agg('```' || lang || chr(10) || code || chr(10) || '```' || chr(10), chr(10) ORDER BY turn) AS codes
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, code ORDER BY turn) AS r FROM m WHERE done) WHERE r = 1 GROUP BY conv_id),
p AS (SELECT conv_id, count(*) AS planned, count(*) FILTER (done) AS n, bool_or(turn = 0) AS noted,
  string_agg((turn + 1) || '. [Part ' || turn || '](#s' || turn || ')' || CASE WHEN done THEN '' ELSE ' ⚠️ 未生成' END, chr(10) ORDER BY turn) AS toc,
  string_agg('> - **s' || turn || '** Part ' || turn || ' (' || {begin} || '-' || {end} || ')', chr(10) ORDER BY turn) FILTER (NOT done) AS lost,
  string_agg('<a id="s' || turn || '"></a>' || chr(10) || md || chr(10), chr(10) ORDER BY turn) FILTER (done) AS body FROM m GROUP BY conv_id)
SELECT conv_id AS video_id, concat_ws(chr(10), '# Video ' || conv_id || chr(10), '> UP主: up | 时长: 01:01:01 | 原视频: http://x' || chr(10),
  CASE WHEN lost IS NOT NULL THEN '> ⚠️ **文档不完整**: ' || n || '/' || planned || chr(10) || lost || chr(10) END, '## 这个教程做什么' || chr(10) || 'topic' || chr(10),
  '## 目录' || chr(10) || toc || chr(10), '## 步骤详解' || chr(10) || chr(10) || coalesce(body, ''), '## 完整代码合集' || chr(10) || chr(10) || codes,
  CASE WHEN noted THEN '## 编辑备注' || chr(10) || chr(10) || '- [s0] **terms**: check' END) AS document FROM p LEFT JOIN c USING (conv_id)"""


@_query(_TEN.format(md=_MD, begin=hms_sql("turn * 60"), end=hms_sql("turn * 60 + 60")))
def t10_assemble(spark: SparkSession, d: str) -> DataFrame:
    md = _markdown(spark, d)
    key = F.col("conv_id").alias("video_id")
    meta = md.select(key).distinct().withColumns({"title": F.concat(F.lit("Video "), "video_id"), "uploader": F.lit("up"), "duration": F.lit(3661.0), "url": F.lit("http://x"), "topic": F.lit("topic")})
    outline = md.select(key, F.col("turn").alias("pos"), F.concat(F.lit("s"), "turn").alias("id"), F.concat(F.lit("Part "), "turn").alias("title"), (F.col("turn") * 60.0).alias("start"), (F.col("turn") * 60.0 + 60).alias("end"))
    done = md.where("turn % 4 <> 3").select(key, F.col("turn").alias("section_pos"), F.concat(F.lit("s"), "turn").alias("section_id"), "md")
    issues = md.where("turn = 0").select(key, F.lit(0).alias("pos"), F.lit("s0").alias("section_id"), F.lit("terms").alias("type"), F.lit("check").alias("note"))
    return assemble.assemble(meta, outline, done, issues)


@_query(f"""WITH d AS (SELECT text, doc_id, row_number() OVER (PARTITION BY {STRIP.format("text")} ORDER BY doc_id) AS r FROM documents WHERE length({STRIP.format("text")}) > 10)
SELECT doc_id FROM d WHERE r = 1""")
def d2_exact(spark: SparkSession, d: str) -> DataFrame:
    return select.exact_text_dedup(load(spark, d, "documents"), "text", ["doc_id"]).select("doc_id")


@_query(f"""WITH {FRAMES} SELECT video_id, string_agg((frame_idx + 1) || '. [' || type || '] f' || event_id, chr(10) ORDER BY frame_idx) AS plan FROM frames GROUP BY video_id""")
def r11_plan(spark: SparkSession, d: str) -> DataFrame:
    from timeloom.operators.timeline import ordered_text

    line = F.concat(F.col("frame_idx") + 1, F.lit(". ["), "type", F.lit("] f"), "event_id")
    return ordered_text(frames(spark, d), ["video_id"], "frame_idx", line, "\n", "plan")


@_query("SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)\\bthe\\b', 'DIE', 'g'), '(?i)\\bof\\b', 'VON', 'g') AS text FROM documents")
def d5_glossary(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(load(spark, d, "documents")).select("doc_id", "text")
    return store.canonical_terms(rows, {"the": "DIE", "of": "VON"}, "text")


@_query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) AS g FROM w)
SELECT doc_id, round(CASE WHEN len(g) > 0 THEN 1 - len(list_distinct(g)) / len(g)::DOUBLE ELSE 0 END, 6) AS share FROM g""")
def d6_ngram_health(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(load(spark, d, "documents")).select("doc_id", F.round(text.repeated_ngram_share(F.col("text")), 6).alias("share"))
    return rows


@_query("SELECT doc_id, round((length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))) / greatest(length(text), 1)::DOUBLE, 6) AS share FROM documents")
def d7_script_share(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.round(text.script_share(F.col("text"), r"[^\x00-\x7F]"), 6).alias("share"))


@_query(f"""WITH {SEGMENTS}, t AS (SELECT video_id, string_agg(text, chr(10) ORDER BY seg_idx) AS t FROM segments GROUP BY video_id),
l AS (SELECT video_id, t, string_split(regexp_replace(t, chr(10) || '$', ''), chr(10)) AS l FROM t),
g AS (SELECT *, CAST(floor(600 / greatest(length(t) / len(l)::DOUBLE, 1)) AS INTEGER) AS target FROM l),
h AS (SELECT *, CAST(floor(target * 0.15::DOUBLE) AS INTEGER) AS head FROM g),
m AS (SELECT *, target - 2 * head AS want, l[head + 1:len(l) - head] AS pool FROM h)
SELECT video_id, CASE WHEN length(t) <= 600 THEN t WHEN target >= len(l) THEN left(t, 600) ELSE array_to_string(list_concat(l[1:head], ['[...]'],
 CASE WHEN want > 0 AND len(pool) > want THEN list_transform(range(0, want), lambda i: pool[CAST(floor(i * (len(pool) / want::DOUBLE)) AS INTEGER) + 1]) ELSE pool END,
 CASE WHEN head > 0 THEN l[len(l) - head + 1:len(l)] ELSE [] END), chr(10)) END AS sampled FROM m""")
def k3_stride(spark: SparkSession, d: str) -> DataFrame:
    from timeloom.operators.timeline import ordered_text

    t = ordered_text(segments(spark, d), ["video_id"], "seg_idx", F.col("text"), "\n", "t")
    return select.stride_sample(t, "t", 600, "[...]").select("video_id", "sampled")


