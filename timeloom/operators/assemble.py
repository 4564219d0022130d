"""Assembly of a document from its sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions.scalars import hms, strip
from timeloom.operators.text import code_blocks, full_code_section
from timeloom.operators.timeline import ordered_text


def collected_code(sections: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, pos, block_pos, lang, code): each code text once, where it first stands.

    A section gives the blocks of its complete-code part if it has any, else all its blocks;
    codes of ten characters or fewer are left out.
    """
    full = code_blocks(full_code_section(F.col("md")))
    blocks = sections.withColumn("_full", full).withColumn("_any", code_blocks(F.col("md")))
    rows = blocks.select(key, F.col("section_pos").alias("pos"), F.posexplode(F.when(F.size("_full") > 0, F.col("_full")).otherwise(F.col("_any"))).alias("block_pos", "b"))
    w = Window.partitionBy(key, "_k").orderBy("pos", "block_pos")
    kept = rows.withColumn("_k", strip(F.col("b.code"))).where(F.length("_k") > 10).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return kept.select(key, "pos", "block_pos", "b.lang", "b.code")


def assemble(meta: DataFrame, outline: DataFrame, sections: DataFrame, issues: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, document), with fixed headings: title, origin, warning of missing sections, topic, contents, sections,
    code collection and editor's notes, in this order.

    ``meta`` has title, uploader, duration, url and topic; ``outline`` (pos, id, title, start,
    end); ``sections`` (section_pos, section_id, md); ``issues`` (pos, section_id, type, note).
    """
    ids = sections.select(key, F.col("section_id").alias("id")).distinct().withColumn("_w", F.lit(True))
    plan = outline.join(ids, [key, "id"], "left").withColumn("_w", F.coalesce("_w", F.lit(False)))
    toc_line = F.concat(F.col("pos") + 1, F.lit(". ["), "title", F.lit("](#"), "id", F.lit(")"), F.when(F.col("_w"), "").otherwise(" ⚠️ 未生成"))
    toc = ordered_text(plan, [key], "pos", toc_line, "\n", "_toc")
    lost_line = F.concat(F.lit("> - **"), "id", F.lit("** "), "title", F.lit(" ("), hms(F.col("start")), F.lit("-"), hms(F.col("end")), F.lit(")"))
    lost = ordered_text(plan.where("not _w"), [key], "pos", lost_line, "\n", "_lost")
    body = ordered_text(sections, [key], "section_pos", F.concat(F.lit('<a id="'), "section_id", F.lit('"></a>\n'), strip(F.col("md")), F.lit("\n")), "\n", "_body")
    counts = plan.groupBy(key).agg(F.count_if("_w").alias("_done"), F.count(F.lit(1)).alias("_planned"))
    code = collected_code(sections, key).withColumn("o", F.struct("pos", "block_pos"))
    codes = ordered_text(code, [key], "o", F.concat(F.lit("```"), "lang", F.lit("\n"), "code", F.lit("\n```\n")), "\n", "_code")
    notes = ordered_text(issues, [key], "pos", F.concat(F.lit("- ["), "section_id", F.lit("] **"), "type", F.lit("**: "), "note"), "\n", "_notes")
    rows = meta
    for part in (toc, lost, body, counts, codes, notes):
        rows = rows.join(part, key, "left")

    def if_any(column: str, *around: Column | str) -> Column:
        parts = [F.lit(a) if isinstance(a, str) else a for a in around]
        return F.when(F.col(column).isNotNull() & (F.col(column) != ""), F.concat(*parts))

    pieces = F.array(
        F.concat(F.lit("# "), "title", F.lit("\n")),
        F.concat(F.lit("> UP主: "), "uploader", F.lit(" | 时长: "), hms(F.col("duration")), F.lit(" | 原视频: "), "url", F.lit("\n")),
        if_any("_lost", "> ⚠️ **文档不完整**: ", F.col("_done"), "/", F.col("_planned"), "\n", F.col("_lost"), "\n"),
        if_any("topic", "## 这个教程做什么\n", F.col("topic"), "\n"),
        F.concat(F.lit("## 目录\n"), F.coalesce("_toc", F.lit("")), F.lit("\n")),
        F.concat(F.lit("## 步骤详解\n\n"), F.coalesce("_body", F.lit(""))),
        if_any("_code", "## 完整代码合集\n\n", F.col("_code")),
        if_any("_notes", "## 编辑备注\n\n", F.col("_notes")),
    )
    return rows.select(key, F.array_join(pieces, "\n").alias("document"))
