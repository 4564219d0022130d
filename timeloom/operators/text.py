"""Parsing, checking and repairing of generated text: captions, stamps, JSON, code and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions.scalars import hms, is_placeholder, lines_of, strip
from timeloom.operators.ranges import nearest, within_tolerance

#: Patterns of time stamps and of caption timings.
_STAMP = r"\[(\d{2}):(\d{2}):(\d{2})\]"
_CUE = r"(\d+):(\d+):(\d+)\.(\d+)\s*-->\s*(\d+):(\d+):(\d+)\.(\d+)"
#: Fixed value: heading of a section's complete code.
FULL_CODE = "本节完整代码"
_FENCE = r"(?s)```(\w*)\n(.*?)\n```"


def parse_captions(files: DataFrame, text: str = "value", key: str = "video_id") -> DataFrame:
    """(key, seg_idx, start, end, text) of WebVTT texts.

    Blocks stand between blank lines and need a timing with hours. A fraction counts as
    thousandths whatever its width. Lines of the block other than the timing and the file's
    heading are the text, cue names included.
    """
    blocks = files.select(key, F.posexplode(F.split(text, r"\n\n+")).alias("_pos", "_block")).where(F.col("_block").rlike(_CUE))

    def at(k: int) -> Column:
        part = [F.regexp_extract("_block", _CUE, k + i).cast("double") for i in range(4)]
        return part[0] * 3600 + part[1] * 60 + part[2] + part[3] / 1000

    lines = F.filter(F.split("_block", "\n"), lambda x: (strip(x) != "") & ~x.rlike(_CUE) & ~x.startswith("WEBVTT"))
    rows = blocks.select(key, "_pos", at(1).alias("start"), at(5).alias("end"), F.array_join(F.transform(lines, strip), " ").alias("text"))
    w = Window.partitionBy(key).orderBy("_pos")
    return rows.withColumn("seg_idx", F.row_number().over(w) - 1).select(key, "seg_idx", "start", "end", "text")


def stamps_of(sections: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, stamp_pos, stamp, at) of every [HH:MM:SS] in the texts."""
    found = sections.select(*key, F.posexplode(F.regexp_extract_all(text, F.lit(_STAMP), 0)).alias("stamp_pos", "stamp"))
    h, m, s = (F.substring("stamp", p, 2).cast("double") for p in (2, 5, 8))
    return found.withColumn("at", h * 3600 + m * 60 + s)


def repair_stamps(sections: DataFrame, segments: DataFrame, key: str, section_id: str, text: str, *, tolerance: float = 5.0) -> DataFrame:
    """The sections with ``repaired`` text and ``changes`` (old→new, in order).

    A stamp stands if it lies within the tolerance of a segment; else it becomes the start of
    the nearest one (of equal ones the earliest). Timelines without segments stay as they are.
    """
    stamps = stamps_of(sections, [key, section_id], text)
    cells = within_tolerance(stamps.select(key, "at").distinct(), segments, key, "at", tolerance).where("not valid").drop("valid")
    fixed = nearest(cells, segments.withColumn("_o", F.col("start")), key, "at", "start", "_o", "start", "new_at").where("new_at is not null")
    marked = stamps.join(fixed.select(key, "at", "new_at"), [key, "at"], "left").withColumn("_new", F.when(F.col("new_at").isNull(), F.col("stamp")).otherwise(F.concat(F.lit("["), hms(F.col("new_at")), F.lit("]"))))
    lists = marked.groupBy(key, section_id).agg(F.array_sort(F.collect_list(F.struct("stamp_pos", "stamp", "_new"))).alias("_m"))
    gaps = F.split(F.col(text), _STAMP, -1)
    joined = F.array_join(F.transform(F.col("_gaps"), lambda g, i: F.concat(g, F.coalesce(F.get("_m", i)["_new"], F.lit("")))), "")
    changes = F.transform(F.filter("_m", lambda x: x["stamp"] != x["_new"]), lambda x: F.concat(x["stamp"], F.lit("→"), x["_new"]))
    out = sections.join(lists, [key, section_id], "left").withColumn("_gaps", gaps)
    none = F.array().cast("array<string>")
    return out.withColumn("repaired", F.when(F.col("_m").isNull(), F.col(text)).otherwise(joined)).withColumn("changes", F.coalesce(changes, none)).drop("_gaps", "_m")


def parse_classification(replies: DataFrame, text: str, types: list[str], fallback: str = "transition", brief_chars: int = 60) -> DataFrame:
    """The rows with ``type``, ``has_text`` and ``brief`` from lines ``TYPE:``, ``HAS_TEXT:``, ``BRIEF:``.

    Prefixes have any case, the last line of a kind counts, an unknown type is the fallback.
    """
    lines = F.transform(lines_of(F.col(text)), strip)

    def last(prefix: str) -> Column:
        own = F.filter(lines, lambda x: F.upper(x).startswith(prefix))
        return F.try_element_at(F.transform(own, lambda x: strip(F.substr(x, F.lit(len(prefix) + 1)))), F.lit(-1))

    kind = F.lower(last("TYPE:"))
    return replies.withColumns({
        "type": F.when(kind.isin(types), kind).otherwise(fallback),
        "has_text": F.coalesce(F.lower(last("HAS_TEXT:")).isin("true", "yes", "1"), F.lit(False)),
        "brief": F.left(F.coalesce(last("BRIEF:"), F.lit("")), F.lit(brief_chars)),
    })


def lenient_json(text: Column, schema: str, keep_slashes: bool = False) -> Column:
    """A JSON object within prose: fenced, or from the first brace to the last.

    Trailing commas and ``//`` comments go before the second try (inside strings too, unless
    ``keep_slashes``); single quotes are allowed. Null if nothing parses.
    """
    t = strip(text)
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    bare = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    body = F.when(fenced != "", fenced).otherwise(bare)
    clean = F.regexp_replace(body, r",(\s*[}\]])", "$1")
    if not keep_slashes:
        clean = F.regexp_replace(clean, r"//[^\n]*", "")
    options = {"allowSingleQuotes": "true", "mode": "PERMISSIVE"}
    return F.when(body != "", F.from_json(clean, schema, options))


def code_blocks(md: Column) -> Column:
    """Array of (lang, code) of fenced blocks, without placeholders.

    An info string that is no word hides its fence, so that the closing fence opens the next
    match, as a pattern over the whole text does.
    """
    pairs = F.arrays_zip(F.regexp_extract_all(md, F.lit(_FENCE), 1).alias("lang"), F.regexp_extract_all(md, F.lit(_FENCE), 2).alias("code"))
    return F.filter(pairs, lambda b: ~is_placeholder(b["code"]))


def full_code_section(md: Column) -> Column:
    """What stands under the first heading for complete code, up to the next heading; empty without one."""
    return F.regexp_extract(md, rf"(?s)###\s*{FULL_CODE}\s*\n(.*?)(?=\n##|\z)", 1)


def drop_empty_full_code(md: Column) -> Column:
    """The text without complete-code sections that hold no real block; it ends in one newline."""
    section = rf"(?s)###\s*{FULL_CODE}\s*\n.*?(?=\n##|\z)"
    parts = F.regexp_extract_all(md, F.lit(f"({section})"), 1)
    gaps = F.split(md, section, -1)
    kept = F.transform(parts, lambda p: F.when(F.size(code_blocks(full_code_section(p))) > 0, p).otherwise(F.lit("")))
    text = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(kept, i), F.lit("")))), "")
    return F.concat(F.regexp_replace(text, r"(?U)\s+$", ""), F.lit("\n"))


def _first_image(line: Column) -> Column:
    return F.regexp_extract(line, r"!\[[^\]]*\]\(([^)]+)\)", 1)


def drop_foreign_images(md: Column, allowed: Column) -> tuple[Column, Column]:
    """Text without lines whose first image is not allowed, and those images' names."""

    def foreign(line: Column) -> Column:
        path = _first_image(line)
        return (path != "") & ~F.array_contains(allowed, F.substring_index(path, "/", -1))

    lines = lines_of(md)
    return F.array_join(F.filter(lines, lambda x: ~foreign(x)), "\n"), F.transform(F.filter(lines, foreign), lambda x: F.substring_index(_first_image(x), "/", -1))


def skeleton(md: Column, chars: int = 120) -> Column:
    """Struct of the first line with text and the first one that is no heading."""
    lines = F.filter(F.transform(lines_of(md), strip), lambda x: x != "")
    heading = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    para = F.coalesce(F.get(F.filter(lines, lambda x: ~x.startswith("#")), F.lit(0)), F.lit(""))
    return F.struct(heading.alias("heading"), F.left(para, F.lit(chars)).alias("first_para"))


def repeated_ngram_share(text: Column, n: int = 3) -> Column:
    """Share of a text's word n-grams that repeat an earlier one: a health check of captions.

    The text is split once, and n-grams are told apart by 64-bit hashes of their words.
    """
    def share(words: Column) -> Column:
        count = F.size(words) - (n - 1)
        grams = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n))))
        return F.when(count > 0, 1 - F.size(F.array_distinct(grams)) / count).otherwise(F.lit(0.0))

    return F.get(F.transform(F.array(F.array_remove(F.split(F.lower(text), r"\s+"), "")), share), F.lit(0))


def script_share(text: Column, pattern: str) -> Column:
    """Share of the characters that match a class, for switching by language mix."""
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))
