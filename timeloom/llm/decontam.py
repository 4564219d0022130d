"""Benchmark decontamination by canonical templates, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.llm.support import clean_text, cut, join_checked, written

#: Words of a template window, words of it that must not be slots, and words of the shortest item
#: that is sought inside documents.
WIDTH, MIN_LITERALS, SHORTEST = 5, 2, 3

#: Names of units that may follow a number.
UNITS = [
    "mm", "cm", "dm", "m", "km", "in", "inch", "inches", "ft", "foot", "feet", "yd", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "t", "ton", "tons", "oz", "lb", "lbs", "pound", "pounds", "ml", "cl", "l", "liter", "liters", "litre", "litres", "gallon", "gallons",
    "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "kmh", "mph", "hz", "khz", "mhz", "ghz", "w", "kw", "v", "a", "j", "kj", "cal", "kcal", "pa", "kpa", "k", "c", "f", "degree", "degrees",
    "dollar", "dollars", "euro", "euros", "cent", "cents", "usd", "eur", "gbp", "percent", "kb", "mb", "gb", "tb",
]

#: English number words, those that may precede another with a hyphen first.
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
ONES = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
OTHERS = ["zero", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "hundred", "thousand", "million", "billion", "dozen"]

_SLOT = "\u0001"
#: Stands before a mark that belongs to a value, until other marks are gone.
_HOLD = "\u0002"
_SPACE = r"\x20\x09-\x0D"
_MARKS = rf"[^\p{{L}}\p{{N}}{_SPACE}{_SLOT}{_HOLD}]"
_EDGE = rf"(?={_MARKS}*(?:[{_SPACE}]|$))"
_HEAD = rf"(?<![^{_SPACE}])"
_UNIT = "|".join(sorted(UNITS, key=lambda u: (-len(u), u)))


def _by_first(words: list[str]) -> str:
    """An alternation of words, those with one first letter together, so that other letters are left at once."""
    return "|".join(f"{x}(?:{'|'.join(w[1:] for w in words if w[0] == x)})" for x in sorted({w[0] for w in words}))


#: A number word: it stands alone, or is joined to others by hyphens.
_SPELT = (
    rf"(?=[{''.join(sorted({w[0] + w[0].upper() for w in TENS + ONES + OTHERS}))}])(?<![\p{{L}}\p{{N}}{_SLOT}'’-])"
    rf"((?i:(?:(?:{_by_first(TENS)})-)?(?:{_by_first(ONES)})|{_by_first(sorted(TENS + OTHERS, key=len, reverse=True))}))(?![\p{{L}}\p{{N}}'’]|-\p{{L}})"
)


def _numbers_marked(t: Column) -> Column:
    """Numbers, with the units on them or after them, as slots. Marks around them stay."""
    # Patterns begin with what is rare, so the engine leaves most places at once.
    number = r"[-+−]?\p{N}+(?:[.,:/]\p{N}+)*"
    t = F.regexp_replace(t, rf"(?=[^\p{{L}}{_SPACE}]){_HEAD}({_MARKS}*?)({number})-?(%|°?\p{{L}}{{1,8}}|){_EDGE}", f"$1{_SLOT}n$2{_SLOT}$3")
    value = rf"{_SLOT}n([^{_SPACE}{_SLOT}]+)"
    t = F.regexp_replace(t, rf"(?i){value}{_SLOT}(%|°?(?:{_UNIT})(?!\p{{L}}))", f"{_SLOT}n$1 {_SLOT}u$2")
    t = F.regexp_replace(t, rf"{value}{_SLOT}(?=[°\p{{L}}])", f"{_SLOT}q$1")
    t = F.regexp_replace(t, rf"{_SLOT}(?![nqu])", "")
    return F.regexp_replace(t, rf"[-+−.,:/%°](?<={_SLOT}[nqu][\p{{N}}.,:/%°+−-]{{1,40}})(?=[\p{{N}}\p{{L}}]|(?<=[%°]))", f"{_HOLD}$0")


def canonical(text: Column) -> Column:
    """The words of a text in lower case and without marks, with slots marked.

    A number becomes ``\\1n`` and its value as it is written, in digits or English words; a
    unit that follows it, or is written on to it, ``\\1u``; a number with other letters on it ``\\1q``; and a name
    ``\\1p``: a capitalised word that follows a word or a comma, hence begins no sentence. Any
    other capitalised word becomes ``\\1c``: it may be a name or a word that begins a sentence,
    a line or a quotation, and windows are read both ways. Words are apart by blanks. Null counts as
    empty.
    """
    t = F.replace(F.replace(clean_text(text), F.lit(_SLOT), F.lit(" ")), F.lit(_HOLD), F.lit(" "))
    t = F.when(t.rlike(r"\p{N}"), _numbers_marked(t)).otherwise(t)
    t = F.regexp_replace(t, _SPELT, f"{_SLOT}n$1")
    # Words of one number are one value.
    slots = F.regexp_replace(t, rf" {_SLOT}n(?=\p{{L}})(?<={_SLOT}n[\p{{L}}-]{{1,20}} {_SLOT}n)", "-")
    slots = F.regexp_replace(slots, rf"({_SLOT}n[^{_SPACE}]*[{_SPACE}])(?:((?i:{_UNIT})(?!\p{{L}}))|(?=%)){_EDGE}", f"$1{_SLOT}u$2")
    slots = F.replace(slots, F.lit(f"{_SLOT}u%"), F.lit(f"{_SLOT}u{_HOLD}%"))
    t = F.when(F.contains(t, F.lit(_SLOT)), slots).otherwise(t)
    t = F.regexp_replace(t, rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}{_SLOT}'’.-])(?=\p{{Lu}}[\p{{L}}'’-])", f"{_SLOT}c")
    t = F.regexp_replace(t, rf"{_SLOT}(?<=[\p{{L}}\p{{N}},] {_SLOT})c", f"{_SLOT}p")
    t = F.regexp_replace(F.lower(t), rf"[^a-z0-9{_SLOT}{_HOLD}{_SPACE}\p{{L}}\p{{N}}](?<!{_HOLD}.)", "")
    for space in "\t\n\x0b\x0c\r":
        t = F.replace(t, F.lit(space), F.lit(" "))
    return F.replace(t, F.lit(_HOLD), F.lit(""))


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def template_tokens(text: Column) -> Column:
    """The words of :func:`canonical` as an array."""
    return _words(canonical(text))


def _template(line: Column) -> Column:
    """A canonical text without the values of its numbers and units; names stay marked."""
    return F.regexp_replace(line, rf"({_SLOT}[nqu])[^ ]*", "$1")


def _plain(line: Column) -> Column:
    """A canonical text without the marks of its slots."""
    return F.regexp_replace(line, rf"{_SLOT}[nqupc]", "")


def _is_slot(w: Column) -> Column:
    return w.startswith(_SLOT) & ~_is_open(w)


def _is_open(w: Column) -> Column:
    """Whether a token may be a name or a word."""
    return w.startswith(_SLOT + "c")


def _is_name(w: Column) -> Column:
    return w.startswith(_SLOT + "p")


def _bare(w: Column) -> Column:
    """A word without the mark of a name, or of a word that may be one."""
    return F.when(_is_open(w) | _is_name(w), F.substring(w, 3, 1 << 30)).otherwise(w)


def _key(w: Column) -> Column:
    """A slot's kind, or the word."""
    return F.when(_is_slot(w), F.substring(w, 1, 2)).otherwise(_bare(w))


def _literal(w: Column) -> Column:
    """A number's or unit's kind, or the word, names included: what is left of it in any case of letters."""
    return F.when(_is_slot(w) & ~_is_name(w), F.substring(w, 1, 2)).otherwise(_bare(w))


def _token_hash(w: Column) -> Column:
    """A hash of a slot's kind or a word, whose last bit tells whether it is a word."""
    return F.xxhash64(w).bitwiseAND(-2).bitwiseOR((~w.startswith(_SLOT)).cast("long"))


def _hashed(tokens: list[Column]) -> Column:
    """Hash of a window's token hashes; null if too few are literal words, which any table of numbers has."""
    return F.when(sum((t.bitwiseAND(1) for t in tokens), F.lit(0)) >= MIN_LITERALS, F.xxhash64(*tokens))


def _valued(tokens: list[Column]) -> Column:
    """Hash of the token hashes of a window's words as they are."""
    return F.xxhash64(F.lit(_SLOT + "v"), *tokens)


def _document_windows(rows: DataFrame, width: int, by_value: bool) -> DataFrame:
    """(doc_id, at, reading) of all windows of ``width`` words of the lines.

    A template window with words that are, or may be, names has up to three readings: with
    those that are names as slots, with all of them as slots, and with none.

    Words are hashed one by one, so that windows are made of numbers: neighbours are zipped and
    exploded, in expressions small enough to be compiled (for several widths at once they are
    not). No filter on them may come before: the optimizer would push a copy of all the expressions
    below it.
    """
    if by_value:
        forms = {"v": F.transform(_words(_plain(F.col("line"))), _token_hash)}
    else:
        words, name = _words(_template(F.col("line"))), F.lit(_SLOT + "p")
        forms = {
            "n": F.transform(words, lambda w: _token_hash(F.when(_is_name(w), name).otherwise(_bare(w)))),
            "m": F.transform(words, lambda w: _token_hash(F.when(_is_name(w) | _is_open(w), name).otherwise(w))),
            "l": F.transform(words, lambda w: _token_hash(_bare(w))),
        }
    hashed = rows.select("doc_id", *(c.alias(f) for f, c in forms.items()))
    shifted = [F.slice(f, k + 1, F.greatest(F.size(f) - k, F.lit(0))).alias(f"{f}{k}") for f in forms for k in range(width)]
    placed = hashed.select("doc_id", F.size(next(iter(forms))).alias("n"), F.posexplode(F.arrays_zip(*shifted)).alias("at", "w"))
    placed = placed.select("doc_id", "at", F.col("n").alias("size"), *(F.col("w").getField(f).alias(f) for f in placed.schema["w"].dataType.names))
    n, m, l, v = ([F.col(f"{f}{k}") for k in range(width)] for f in "nmlv")
    if by_value:
        # So short an item has to be all that the document says.
        whole = placed.where((F.col("size") == width) | F.lit(width >= SHORTEST)).where(v[-1].isNotNull())
        return whole.select("doc_id", "at", _valued(v).alias("reading"))

    def where_other(of: list[Column]) -> Column:
        return F.when(reduce(Column.__or__, (x != y for x, y in zip(of, n, strict=True))), _hashed(of))

    each = placed.where(n[-1].isNotNull()).select("doc_id", "at", _hashed(n).alias("plain"), where_other(m).alias("named"), where_other(l).alias("literal"))
    return each.select("doc_id", "at", F.explode(F.array("plain", "named", "literal")).alias("reading")).where("reading is not null")


_ITEM = ["item_id", "item_key"]


def benchmark_templates(benchmark: DataFrame) -> DataFrame:
    """(item_id, item_key, tokens, width, by_value, n_wins, item_at, win, part), a row for each window of an item.

    ``item_key`` tells the texts of one id apart. Repeated and null rows are left out. Items of
    fewer than ``WIDTH`` words are one window. An item without a window of ``MIN_LITERALS``
    literal words, or with fewer than ``SHORTEST`` words, goes by its words as they are.
    """
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    rows = items.select("item_id", F.md5(F.col("text").cast("binary")).alias("item_key"), template_tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    rows = cut(rows).withColumn("width", F.least(F.size("tokens"), F.lit(WIDTH)))
    placed = rows.withColumn("item_at", F.explode(F.sequence(F.lit(0), F.size("tokens") - F.col("width")))).withColumn("part", F.slice("tokens", F.col("item_at") + 1, F.col("width")))

    def of_width(make) -> Column:
        found = F.lit(None).cast("long")
        for w in range(1, WIDTH + 1):
            found = F.when(F.col("width") == w, make([F.get("part", F.lit(k)) for k in range(w)])).otherwise(found)
        return found

    placed = placed.withColumn("_template", F.when(F.col("width") >= SHORTEST, of_width(lambda parts: _hashed([_token_hash(_key(p)) for p in parts]))))
    placed = placed.withColumn("_valued", of_width(lambda parts: _valued([_token_hash(F.when(p.startswith(_SLOT), F.substring(p, 3, 1 << 30)).otherwise(p)) for p in parts])))
    whole = Window.partitionBy(*_ITEM)
    placed = placed.withColumn("by_value", F.count("_template").over(whole) == 0).withColumn("win", F.when(F.col("by_value"), F.col("_valued")).otherwise(F.col("_template")))
    placed = placed.where("win is not null").withColumn("n_wins", F.size(F.collect_set("win").over(whole)))
    return placed.select(*_ITEM, "tokens", "width", "by_value", "n_wins", "item_at", "win", "part")


def _readings(windows: DataFrame) -> DataFrame:
    """The windows with ``reading``: each with each choice of its words that may be names as names, and with all names as words.

    ``reach`` is how far the parts of a copy may be moved against each other.
    """
    rows = windows.withColumn("reach", F.greatest(F.size("tokens"), F.lit(8))).drop("tokens")
    valued = rows.where("by_value").withColumn("reading", F.col("win"))
    masked = rows.where("not by_value").withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << WIDTH) - 1))))
    parts = [F.get("part", F.lit(k)) for k in range(WIDTH)]
    chosen = [F.col("mask").bitwiseAND(1 << k) != 0 for k in range(WIDTH)]
    masked = masked.where(sum((F.when(c & ~F.coalesce(_is_open(p), F.lit(False)), 1).otherwise(0) for c, p in zip(chosen, parts, strict=True)), F.lit(0)) == 0)
    reading = F.lit(None).cast("long")
    for w in range(SHORTEST, WIDTH + 1):
        read = [_token_hash(F.when(c, F.lit(_SLOT + "p")).otherwise(_key(p))) for c, p in zip(chosen[:w], parts[:w], strict=True)]
        reading = F.when(F.col("width") == w, _hashed(read)).otherwise(reading)
    masked = masked.withColumn("reading", reading).drop("mask")
    literal = F.lit(None).cast("long")
    for w in range(SHORTEST, WIDTH + 1):
        literal = F.when(F.col("width") == w, _hashed([_token_hash(_literal(p)) for p in parts[:w]])).otherwise(literal)
    spelt = rows.where("not by_value").withColumn("reading", literal)
    return masked.unionByName(spelt).where("reading is not null").unionByName(valued).drop("part", "width", "by_value").distinct()


def _as_kind(b: Column, a: Column) -> Column:
    """A document's token that may be a name, as one where the item has a name."""
    return F.when(_is_open(b) & a.startswith(_SLOT + "p"), F.concat(F.lit(_SLOT + "p"), F.substring(b, 3, 1 << 30))).otherwise(b)


def _candidates(met: DataFrame, placed: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, item) of documents that hold one of an item's rarest windows.

    A copy may lack ``n_wins`` - ceil(``similarity`` * ``n_wins``) windows, so it holds at least
    one of any set of one more. Taking the rarest ones keeps windows that many items or
    documents have from making rows for each pair of them.
    """
    often = met.groupBy("reading").agg(F.count(F.lit(1)).alias("n"))
    of_item = placed.select(*_ITEM, "n_wins", "win", "reading").distinct()
    wins = join_checked(of_item, often, ["reading"], "left").groupBy(*_ITEM, "n_wins", "win").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*_ITEM).orderBy("n", "win"))
    rare = wins.withColumn("rank", rank).where(F.col("rank") <= F.col("n_wins") - F.ceil(similarity * F.col("n_wins") - 1e-9) + 1).select(*_ITEM, "win")
    keys = of_item.join(rare, [*_ITEM, "win"]).select(*_ITEM, "reading").distinct()
    return join_checked(met, keys, ["reading"], "inner").select("doc_id", *_ITEM).distinct()


def contaminated(documents: DataFrame, benchmark: DataFrame, *, similarity: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_windows, n_hits, n_slots, n_changed, at_word) of items found in documents.

    An item is found if a stretch of a document holds at least ``similarity`` of the item's
    distinct five-word template windows, at places that agree to within the item's own length
    (eight words at least), and the slots agree: from the first to the last word of the copy,
    the document has a slot of the same kind at every slot of the item (aligned by the windows
    on either side, so inserted words move what follows), a value that the item repeats is
    replaced by one value throughout, and two names stay two (two numbers may become equal by
    chance). Letters may be in any case: windows are also read with all names as words, and a
    name in another case is unchanged. Every place of an item in a document is checked by itself,
    and the best of those that pass is given. ``n_changed`` of ``n_slots`` values differ, so 0 means a
    plain copy and more a re-parameterised one. Clean documents give no row.

    * An item of three or four words is one window of that length.
    * An item without a window of two literal words (a table of numbers) is sought by its
      words as they are, values included.
    * An item of one or two words is found in a document that says nothing else.

    Windows of all documents meet the items' in one hash join, which keeps a row for each window
    that any item has. Items are paired with documents by their rarest windows alone
    (:func:`_candidates`), exactly. The items' windows are broadcast only if they are few enough;
    beyond that both sides are shuffled on the window hash. The documents' tokens are made again
    only for the documents with a candidate. Null texts and rows with a null doc_id hold nothing.
    Each text of an item id that repeats is sought by itself; the best one is given.
    """
    windows = cut(benchmark_templates(benchmark))
    placed = cut(_readings(windows))
    rows = documents.where("doc_id is not null").select("doc_id", canonical(F.col("text")).alias("line"))
    kinds = {(r.width, r.by_value) for r in windows.select("width", "by_value").distinct().collect()} | {(WIDTH, False)}
    wins = reduce(DataFrame.unionAll, [_document_windows(rows, *kind) for kind in sorted(kinds)])
    met = written(join_checked(wins, placed.select("reading").distinct(), ["reading"], "left_semi"))
    pairs = _candidates(met, placed, similarity)
    hits = join_checked(join_checked(met, pairs, ["doc_id"], "inner"), placed, [*_ITEM, "reading"], "inner")
    moved = F.col("at") - F.col("item_at")
    lane = F.explode(F.array(F.floor(moved / (2 * F.col("reach"))) * 2, F.floor((moved + F.col("reach")) / (2 * F.col("reach"))) * 2 + 1))
    found = (
        hits.withColumn("lane", lane)
        .groupBy("doc_id", *_ITEM, "n_wins", "lane")
        .agg(F.collect_set(F.struct("win", "item_at", moved.alias("shift"))).alias("hits"))
        .withColumn("n_hits", F.size(F.array_distinct(F.transform("hits", lambda h: h["win"]))))
        .where(F.col("n_hits") >= similarity * F.col("n_wins") - 1e-9)
    )
    # Every place in every lane is a candidate; a document's tokens are made once for all of them.
    one = F.struct(*_ITEM, "n_wins", "n_hits", F.transform("hits", lambda h: h.dropFields("win")).alias("hits"))
    matched = join_checked(documents.select("doc_id", "text"), found.groupBy("doc_id").agg(F.collect_set(one).alias("found")), ["doc_id"], "inner")
    low = F.greatest(F.array_min(F.transform("found.hits", lambda h: h["shift"])), F.lit(0))
    high = F.array_max(F.transform("found.hits", lambda h: h["shift"]))
    names = F.transform(F.filter("tokens", lambda w: w.startswith(_SLOT + "p")), lambda w: F.substring(w, 3, 1 << 30))
    named = windows.select(*_ITEM, "width", F.col("tokens").alias("item_tokens"), names.alias("item_names")).distinct()
    lanes = matched.select("doc_id", template_tokens(F.col("text")).alias("tokens"), F.explode("found").alias("found"))
    # Of a document's tokens each row keeps those that lie under the item at one of its places.
    near = lanes.select("doc_id", "found.*", low.alias("low"), high.alias("high"), "tokens").join(named, _ITEM)
    near = cut(near.withColumn("tokens", F.slice("tokens", F.col("low") + 1, F.greatest(F.col("high") - F.col("low") + F.size("item_tokens"), F.lit(0)))))
    aligned = cut(near.withColumn("shift", F.explode(F.array_distinct(F.transform("hits", lambda h: h["shift"])))))

    # A place that has enough windows by itself is judged by them, and where it has none by those that an edit may have moved.
    own = F.filter("hits", lambda h: h["shift"] == F.col("shift"))
    slack = F.greatest(F.lit(1), F.floor((1 - similarity) * F.size("item_tokens")))
    aligned = aligned.withColumn("own", own)
    moved_by_edits = F.filter("hits", lambda h: (F.abs(h["shift"] - F.col("shift")) <= slack) & ~F.exists("own", lambda o: o["item_at"] == h["item_at"]))
    aligned = cut(aligned.withColumn("hits", F.when(F.size("own") >= similarity * F.col("n_wins") - 1e-9, F.concat("own", moved_by_edits)).otherwise(F.col("hits"))).drop("own"))
    # A word that may be a name is one if its text has it elsewhere as a name.
    aligned = aligned.withColumn("item_tokens", F.transform("item_tokens", lambda w: F.when(_is_open(w) & F.array_contains("item_names", F.substring(w, 3, 1 << 30)), F.concat(F.lit(_SLOT + "p"), F.substring(w, 3, 1 << 30))).otherwise(w)))
    edges = {"first": F.array_min(F.transform("hits", lambda h: h["item_at"])), "last": F.array_max(F.transform("hits", lambda h: h["item_at"])) + F.col("width") - 1}
    aligned = cut(aligned.withColumns(edges))

    def nearest(i: Column, before: bool) -> Column:
        """The shift of the hit nearest to an item's word, of those not after or not before it; of equally near ones the one nearest to ``shift``."""
        side = F.filter("hits", lambda h: h["item_at"] <= i if before else h["item_at"] + F.col("width") > i)
        gap = lambda h: F.struct(F.greatest(h["item_at"] - i, i - h["item_at"] - F.col("width") + 1, F.lit(0)), F.abs(h["shift"] - F.col("shift")), h["shift"].alias("shift"))
        return F.array_min(F.transform(side, gap))["shift"]

    def places(w: Column, i: Column) -> Column:
        return F.struct(w.alias("a"), i.alias("i"), F.array_compact(F.array(nearest(i, True), nearest(i, False))).alias("shifts"))

    def same(a: Column, b: Column) -> Column:
        kind = _is_slot(b) & (F.substring(b, 1, 2) == F.substring(a, 1, 2))
        # A name in capitals or small letters is still that name.
        return F.when(_is_slot(a), kind | (_is_name(a) & (_bare(a) == _bare(b)))).otherwise((_bare(b) == _bare(a)) | (_is_open(a) & (_is_open(b) | b.startswith(_SLOT + "p"))))

    def under(p: Column) -> Column:
        """The item's word, and the document's word under it if it is the same or a slot of the same kind."""
        words = F.transform(p["shifts"], lambda s: F.when(p["i"] + s >= F.col("low"), _as_kind(F.get("tokens", (p["i"] + s - F.col("low")).cast("int")), p["a"])))
        found = F.get(F.filter(words, lambda b: same(p["a"], b)), F.lit(0))
        return F.struct(p["a"].alias("a"), p["i"].alias("i"), F.when(_bare(found) == _bare(p["a"]), p["a"]).otherwise(found).alias("b"))

    laid = cut(aligned.withColumn("words", F.transform("item_tokens", places)).drop("item_tokens", "item_names", "hits"))
    laid = cut(laid.withColumn("words", F.transform("words", under)).drop("tokens"))
    # The copy reaches as far as its words agree, beyond its outermost windows by less than one.
    reached = F.transform(F.filter("words", lambda p: p["b"].isNotNull() & p["i"].between(F.col("first") - WIDTH + 1, F.col("last") + WIDTH - 1)), lambda p: p["i"])
    laid = cut(laid.withColumn("reached", reached))
    begin, end = F.array_min("reached"), F.array_max("reached")
    laid = cut(laid.withColumn("slots", F.filter("words", lambda p: _is_slot(p["a"]) & (p["b"].isNotNull() | p["i"].between(begin, end)))).drop("words"))
    checked = laid.where(~F.exists("slots", lambda p: p["b"].isNull())).withColumn("slots", F.transform("slots", lambda p: p.dropFields("i")))
    names_in = F.array_distinct(F.filter("slots", lambda p: _is_name(p["a"])))
    one_for_one = F.size(names_in) == F.size(F.array_distinct(F.transform(names_in, lambda p: p["b"])))
    checked = cut(checked).where((F.size(F.array_distinct("slots")) == F.size(F.array_distinct(F.transform("slots", lambda p: p["a"])))) & one_for_one)
    result = checked.select(
        "doc_id", "item_id", F.col("n_wins").alias("n_windows"), "n_hits",
        F.size("slots").alias("n_slots"),
        F.size(F.filter("slots", lambda p: p["a"] != p["b"])).alias("n_changed"),
        F.greatest("shift", F.lit(0)).cast("int").alias("at_word"),
    )
    best = F.struct("n_hits", -F.col("n_changed"), -F.col("n_windows"), -F.col("at_word"))
    return result.groupBy("doc_id", "item_id").agg(*(F.max_by(c, best).alias(c) for c in ("n_windows", "n_hits", "n_slots", "n_changed", "at_word")))


def remove_contaminated(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents in which no item was found; columns stay as they are."""
    return join_checked(documents, found.select("doc_id").distinct(), ["doc_id"], "left_anti").select(documents.columns)
