"""Templates over prose as it is written, against a restatement in Python, and planted copies of all kinds."""

import random
import re
from itertools import product

from data import prose, words

from timeloom.llm import decontam

NAMES = ["Alice", "Bob", "Carol", "Dave", "Erin", "Frank", "Grace", "Heidi"]
SPELT = ["two", "three", "nine", "twelve", "twenty", "thirty-five"]
UNITS = ["km", "hours", "kg", "euros", "minutes", "%"]
VERBS = ["gives", "sells", "carries", "counts", "lends", "shows", "sends", "brings"]
THINGS = ["apples", "boxes", "cows", "coins", "letters", "stamps", "bricks", "pears"]


def problem(r: random.Random) -> tuple[str, dict[str, str]]:
    """A word problem with {slots}, and values for them."""
    a, b, c = r.sample(range(3), 3)
    parts = [
        f"{{p0}} {r.choice(VERBS)} {{p1}} {{n0}} {r.choice(THINGS)} and {{n1}} {r.choice(THINGS)} {prose(r.randrange(10**6), 4)}.",
        f"The way to {{p2}} is {{m0}}, \"{prose(r.randrange(10**6), 5)}\", and takes {{m1}}. How far does {{p0}} come {prose(r.randrange(10**6), 3)}?",
        f"Then {{p1}} {r.choice(VERBS)} {{n2}} of the {r.choice(THINGS)} ({prose(r.randrange(10**6), 4)}), so {{p2}} has {{n1}} left; what is it?",
    ]
    return " ".join(parts[k] for k in (a, b, c)), values(r)


def values(r: random.Random) -> dict[str, str]:
    names, units, spell = r.sample(NAMES, 3), r.sample(UNITS, 2), lambda: r.choice([str(r.randrange(2, 999)), f"{r.randrange(1, 99)}.{r.randrange(1, 9)}", f"{r.randrange(1, 9)},{r.randrange(100, 999)}", r.choice(SPELT)])
    digits = lambda: str(r.randrange(2, 90))
    return {f"p{k}": n for k, n in enumerate(names)} | {f"n{k}": spell() for k in range(3)} | {f"m{k}": digits() + r.choice([" ", ""]) + units[k] for k in range(2)}


LETTER, MARK = r"[^\W\d_]", r"[^\w\s]"


def plain_tokens(text: str) -> list[tuple[str, str]]:
    """(kind, value) of each word, from the words alone: n, u, q, p, c or w."""
    out, before, number = [], "", False
    for w in words(text):
        core = re.sub(r"[^\w]", "", w).lower()
        m = re.fullmatch(rf"{MARK}*?([-+]?\d+(?:[.,:/]\d+)*)-?(%|{LETTER}{{1,8}})?{MARK}*", w)
        s = re.fullmatch(rf"{MARK}*((?:(?:{'|'.join(decontam.TENS)})-)?(?:{'|'.join(decontam.ONES)})|{'|'.join(decontam.TENS + decontam.OTHERS)}){MARK}*", w.lower())
        was, number = number, False
        if m and m[2] and m[2] != "%" and m[2].lower() not in decontam.UNITS:
            out.append(("q", (m[1] + m[2]).lower()))
        elif m:
            out.append(("n", m[1]))
            out += [("u", m[2].lower())] if m[2] else []
            number = not m[2]
        elif s:
            out.append(("n", core))
            number = True
        elif was and w.rstrip(".,;?)\"") == "%":
            out.append(("u", "%"))
        elif was and core in decontam.UNITS and w[0].isalpha():
            out.append(("u", core))
        elif core:
            at = re.search(r"(?<![\w'’.-])[A-Z][^\W\d_]|(?<![\w'’.-])[A-Z]['’-]", w)
            kind = "w" if not at else "p" if at.start() == 0 and re.search(r"[^\W_]$|,$", before) else "c"
            out.append((kind, core))
        before = w
    return out


def readings(window: list[tuple[str, str]], item: bool) -> set[tuple]:
    """What a window may be read as; windows of fewer than two words that are no slots have no reading."""
    fixed = lambda t: t[0] if t[0] in "nuq" else t[1]
    open_ = [k for k, t in enumerate(window) if t[0] == "c"]
    choices = [dict(zip(open_, x, strict=True)) for x in product((False, True), repeat=len(open_))] if item else [dict.fromkeys(open_, x) for x in (False, True)]
    out = set()
    for chosen in choices:
        out.add(tuple("<p>" if t[0] == "p" or chosen.get(k) else f"<{t[0]}>" if t[0] in "nuq" else t[1] for k, t in enumerate(window)))
    out.add(tuple(f"<{t[0]}>" if t[0] in "nuq" else fixed(t) for t in window))
    return {x for x in out if sum(not y.startswith("<") for y in x) >= 2}


def restated(text: str, item: str) -> bool:
    """Whether the text holds a copy of the item with its words in place, by trying every place."""
    a, b = plain_tokens(item), plain_tokens(text)
    spans = {k: readings(a[k : k + 5], True) for k in range(len(a) - 4)}
    template = {k: tuple("<p>" if t[0] == "p" else f"<{t[0]}>" if t[0] in "nuq" else t[1] for t in a[k : k + 5]) for k in spans}
    wanted = {k: w for k, w in template.items() if sum(not y.startswith("<") for y in w) >= 2}
    doc = [readings(b[k : k + 5], False) for k in range(len(b) - 4)]
    names = {t[1] for t in a if t[0] == "p"}
    full = [("p", t[1]) if t[0] == "c" and t[1] in names else t for t in a]
    for shift in range(-len(a), len(b)):
        hit = [k for k in wanted if 0 <= k + shift < len(doc) and spans[k] & doc[k + shift]]
        if not wanted or len({wanted[k] for k in hit}) < 0.8 * len(set(wanted.values())) - 1e-9:
            continue
        pairs, ok = set(), True
        for k in range(hit[0], hit[-1] + 5):
            x, y = full[k], b[k + shift]
            if x[0] in "nuqp":
                same = x[0] == y[0] or (x[0] == "p" and (y[0] == "c" or x[1] == y[1]))
                ok &= same
                pairs.add((x, y[1]))
        named = {p for p in pairs if p[0][0] == "p"}
        if ok and len(pairs) == len({p[0] for p in pairs}) and len(named) == len({p[1] for p in named}):
            return True
    return False


def changed(r: random.Random, kind: str, form: str, own: dict[str, str]) -> tuple[str, bool]:
    """A variant of an item, and whether it is a copy."""
    plain, new = form.format(**own), values(r)
    while new["p0"] == own["p0"]:
        new = values(r)
    if kind in ("lower", "upper", "title"):
        return getattr(plain, kind)(), True
    if kind == "marks":
        return plain.replace("? ", "; ").replace('"', ""), True
    if kind == "new":
        return form.format(**new), True
    if kind == "numbers":
        return form.format(**own | {k: v for k, v in new.items() if k[0] == "n"}), True
    if kind == "units":
        return form.format(**own | {k: re.sub(r"(\d+) ?(.*)", lambda m: f"{int(m[1]) + 1}{'' if ' ' in v else ' '}{m[2]}", v) for k, v in own.items() if k[0] == "m"}), True
    if kind == "merged":  # two people of the item are one in the text
        return form.format(**new | {"p1": new["p0"]}), False
    if kind == "torn":  # one person of the item is two
        return form.format(**new).replace(new["p0"], "Zoe", 1), False
    return prose(r.randrange(10**6), 60), False


KINDS = ["lower", "upper", "title", "marks", "new", "numbers", "units", "merged", "torn", "clean"]


def test_planted_copies_of_all_kinds(spark):
    r = random.Random(5)
    items = {i: problem(r) for i in range(40)}
    docs, plants = {}, {}
    for i, (form, own) in items.items():
        for k, kind in enumerate(KINDS):
            text, copy = changed(r, kind, form, own)
            docs[100 * i + k] = f"{prose(r.randrange(10**6), 30)}. {text} {prose(r.randrange(10**6), 30)}"
            plants[100 * i + k] = (kind, copy)
    bench = spark.createDataFrame([(i, form.format(**own)) for i, (form, own) in items.items()], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in decontam.contaminated(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), bench).collect()}
    found = {kind: sum((d, d // 100) in got for d, (k, _) in plants.items() if k == kind) / len(items) for kind in KINDS}
    assert min(found[k] for k in KINDS[:7]) >= 0.95, str(found)
    assert found["merged"] <= 0.05 and found["torn"] <= 0.05 and found["clean"] == 0, found
    assert all(d // 100 == i for d, i in got)
    assert all(got[d, d // 100].n_changed == 0 for d, (k, _) in plants.items() if k in ("lower", "upper", "title") and (d, d // 100) in got)
    want = {(d, i) for d, t in docs.items() for i, (form, own) in items.items() if d // 100 == i and restated(t, form.format(**own))}
    assert set(got) == want, {(d, plants[d][0]) for d, _ in set(got) ^ want}


def one(spark, item, texts):
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {x.doc_id: x.n_changed for x in decontam.contaminated(docs, bench).collect()}


def test_words_after_units_are_no_names(spark):
    item = "A train goes 60 km in 2 hours. How far does it go in the next day of its long way?"
    assert one(spark, item, [item.replace("How", "Tell how"), item.replace(". How", "; how"), item.replace("How far", "Say far"), item.replace("60 km in 2 hours", "60km in 2h"), item.replace("60 km", "75km")]).keys() >= {1, 3, 4}


def test_values_are_compared_as_written(spark):
    item = "the ship sails at 3.5 knots from 1:30 on and comes to the far port with 12 men and -4 degrees on board"
    got = one(spark, item, [item, item.replace("3.5", "35"), item.replace("1:30", "130"), item.replace("-4", "4"), item.replace("3.5", "35").replace("1:30", "130")])
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 2}
    assert one(spark, "1.5 2.5 3.5 4.5 5.5 6.5", ["15 25 35 45 55 65", "so 1.5 2.5 3.5 4.5 5.5 6.5 it is"]) == {1: 0}


def test_number_words_and_two_names(spark):
    item = "the farmer keeps twenty cows and five pigs in the old barn behind the mill and sells one hundred eggs"
    assert one(spark, item, [item.replace("twenty", "thirty").replace("five", "9"), item.replace("one hundred", "ninety-two")]) == {0: 2, 1: 1}
    item = "now Alice gives Bob 5 apples and goes home to rest, then Alice asks Bob for some of them"
    assert one(spark, item, [item.replace("Alice", "Carol").replace("Bob", "Carol"), item.replace("Alice", "Carol"), item.replace("5", "7")]) == {1: 2, 2: 1}


def test_tokens_equal_the_restatement(spark):
    r = random.Random(9)
    texts = [form.format(**v) for form, v in (problem(r) for _ in range(60))]
    texts += [t.upper() for t in texts[:20]] + [t.lower() for t in texts[:20]] + ["5-km runs of 3rd men, (12%) or 7° on 1/2 twenty-one days; one-way \"Two\" Bob's o'Neil No.", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", decontam.template_tokens("text").alias("t")).collect()
    for row in rows[: -3]:
        assert [(w[1], w[2:]) if w[0] == "\x01" else ("w", w) for w in row.t] == [(k, v) for k, v in plain_tokens(texts[row.i])], texts[row.i]
    odd = ["".join(w) for w in rows[-3].t]
    assert odd[:6] == ["\x01n5", "\x01ukm", "runs", "of", "\x01q3rd", "men"] and "\x01u%" in odd and "\x01ntwentyone" in odd and "oneway" in odd
    assert rows[-2].t == rows[-1].t == []
