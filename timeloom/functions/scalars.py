"""Column functions: text, time, URL and code predicates. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Openings that speech recognition invents.
HALLUCINATIONS = [r"^请订阅", r"^感谢观看", r"^字幕由.*提供", r"^明镜", r"^点点栏目", r"^MING PAO", r"^由.*翻译"]

#: Phrases by which a speaker points at the screen.
ANCHORS = [
    "look at this", "this code", "as you can see", "on the screen", "here we", "right here", "this part", "this function",
    "this variable", "notice that", "pay attention",
    "看这", "这段代码", "如图", "注意这", "这个函数", "这里我们", "屏幕上", "这个变量", "这一步",
]

#: Phrases that give away a code block without code.
PLACEHOLDERS = ["未涉及", "此处添加", "暂无代码", "no code", "// TODO", "# TODO", "省略", "..."]

#: Fixed value: marks that end a sentence.
SENTENCE_END = r"[.!?。！？…]+\s*$"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends (``trim`` takes spaces alone)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lines_of(text: Column) -> Column:
    return F.split(text, r"\R")


def hms(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds; hours widen beyond 99."""
    s = seconds.cast("int")
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("int"), ((s % 3600) / 60).cast("int"), s % 60)


def is_hallucination(text: Column) -> Column:
    """Whether stripped text is empty or begins as invented speech does."""
    s = strip(text)
    return (s == "") | s.rlike("|".join(HALLUCINATIONS))


def is_anchor(text: Column) -> Column:
    return text.rlike("(?iu)" + "|".join(ANCHORS))


def contains_keyword(text: Column, keyword: str) -> Column:
    """Literal search without case; the empty keyword is in every text."""
    return F.contains(F.lower(text), F.lower(F.lit(keyword)))


def is_placeholder(code: Column) -> Column:
    """Code that is none: under ten characters, comments alone, or with a placeholder phrase.

    An ellipsis is such a phrase, wherever it stands.
    """
    s = strip(code)
    live = F.filter(lines_of(s), lambda x: (strip(x) != "") & ~strip(x).startswith("#") & ~strip(x).startswith("//"))
    phrase = F.lit(False)
    for p in PLACEHOLDERS:
        phrase = phrase | s.contains(p)
    return (F.length(s) < 10) | (F.size(live) == 0) | phrase


def ends_sentence(text: Column) -> Column:
    return text.rlike(SENTENCE_END)


def url_key(url: Column) -> Column:
    """Last path component before ``?`` (empty if ``?`` follows a slash)."""
    return F.substring_index(F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1), "?", 1)


def media_id(url: Column) -> Column:
    """All digits as they are; else the digits after ``/video/``; else null."""
    return F.when(url.rlike(r"^\d+$"), url).otherwise(F.nullif(F.regexp_extract(url, r"/video/(\d+)", 1), F.lit("")))


def relative_path(path: Column) -> Column:
    """Last two components, with forward slashes."""
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -2)


def site(url: Column, marker: str, this: str, other: str) -> Column:
    return F.when(F.contains(F.lower(url), F.lit(marker)), this).otherwise(other)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes held as longs."""
    return F.bit_count(a.bitwiseXOR(b))


def hash_bits(hex16: Column) -> Column:
    """64-bit hash from 16 hex digits; null for an empty string."""
    return F.conv(F.nullif(hex16, F.lit("")), 16, -10).cast("long")


def render(template: str, **values: Column) -> Column:
    """A template with ``{name}`` places filled in; doubled braces stand for themselves.

    A null value is an empty text, and a name without a value is an error.
    """
    import string

    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(F.lit(""), *parts)
