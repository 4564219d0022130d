"""Small documents with every odd case, and helpers for brute force."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, spans string, shard string, ids string, rep string, win string"


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(seed: int, n: int, vocabulary: int = 4000) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def odd_documents(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing names."""
    base = prose(1, 120)
    edited = base.split()
    edited[60] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(edited)), (4, None), (5, ""), (6, "   \n\t "), (7, "one"), (8, "two words"),
        (9, prose(2, 30_000)), (10, "same " * 5000), (11, prose(3, 200) + "\n" + base), (12, "Ünïcode ßtraße 日本語 " * 10),
        (None, base), (None, None), (13, prose(4, 80)), (13, prose(4, 80)),
    ]
    return spark.createDataFrame([(i, t, None if i == 7 else "en", None if i == 8 else f"s{(i or 0) % 2}", len(t) if t else None, "x", "x", "x", "x", "x", "x") for i, t in rows], SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def grams(text: str | None, n: int = 5) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
