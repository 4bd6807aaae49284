"""Text layout against a rule by rule walk."""

import random

import numpy as np
import pytest

from quirework.operators import lines


def walk(text, most, indent):
    """Lines (first, n) of a text with LF only, one character after the other."""
    width = lambda s: int(lines.advances(np.array([ord(c) for c in s], np.int64)).sum()) if s else 0
    out, at = [], 0
    for p, paragraph in enumerate(text.split("\n")):
        i = 0
        while True:
            room, j = most - (indent if i == 0 else 0), i
            while j < len(paragraph) and width(paragraph[i : j + 1]) <= room:
                j += 1
            if not paragraph[j:].strip(" "):
                out.append((p, at + i, len(paragraph[i:].rstrip(" "))))
                break
            if paragraph[j] == " ":
                n, following = len(paragraph[i:j].rstrip(" ")), j + len(paragraph[j:]) - len(paragraph[j:].lstrip(" "))
            elif " " in paragraph[i:j] and paragraph[i : i + paragraph[i:j].rfind(" ")].strip(" "):
                c = i + paragraph[i:j].rfind(" ")
                n, following = len(paragraph[i:c].rstrip(" ")), c + 1
            else:
                following = max(j, i + 1)
                n = following - i
            out.append((p, at + i, n))
            i = following
        at += len(paragraph) + 1
    return out


def made(rng):
    words = ["a", "ill", "WWW", "mm", "word", "é", "日本語", "é", "x" * 40, "", " "]
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", "\n\n", "   "]) for _ in range(rng.randrange(60)))


@pytest.mark.parametrize("most, indent", [(5000, 0), (5000, 1500), (900, 100), (100, 0), (0, 0), (30000, 2000)])
def test_broken_equals_a_walk(most, indent):
    rng = random.Random(most)
    texts = [t for t in (made(rng) for _ in range(60)) if t.removesuffix("\n")]
    texts = [t.removesuffix("\n") for t in texts]
    points = np.array([ord(c) for t in texts for c in t + "\n"], np.int64)
    of, paragraph, first, n, width, opening = lines.broken(points, np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts]), most, indent)
    for i, t in enumerate(texts):
        own = of == i
        assert list(zip(paragraph[own].tolist(), first[own].tolist(), n[own].tolist(), strict=True)) == walk(t, most, indent), repr(t)


def test_table(spark, monkeypatch):
    """Pieces of a few hundred characters, so that long texts are cut between paragraphs."""
    rng = random.Random(2)
    rows = [(i, made(rng), "n") for i in range(80)] + [(100, None, "n"), (101, "", "n"), (102, "\n", "n"), (103, "a\r\n\rb\r", "n"), (104, "word " * 5000 + "\n" + "x" * 3000, "n")]
    df = spark.createDataFrame(rows, "id long, text string, width string").repartition(3)
    out = lines.laid_out(df, width=60.0, size=10.0, first_line_indent=5.0, left_indent=10.0, alignment=2)
    assert out.columns == ["id", "line", "paragraph", "first_char", "n_chars", "width", "x", "y"]
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r["id"], r["line"])):
        got.setdefault(r["id"], []).append((r["paragraph"], r["first_char"], r["n_chars"]))
        assert r["line"] == len(got[r["id"]]) - 1 and r["y"] == r["line"] * (1.2 * 10.0)
        opens = r["paragraph"] != (got[r["id"]][-2][0] if len(got[r["id"]]) > 1 else -1)
        assert abs(r["x"] + r["width"] / 100 - 60) < 1e-9 or r["n_chars"] == 1 or opens
    for i, text, _ in rows:
        plain = (text or "").replace("\r\n", "\n").replace("\r", "\n")
        assert got.get(i, []) == (walk(plain.removesuffix("\n"), 5000, 500) if plain else []), i


def test_pieces():
    texts = ["ab\ncd\nef", "", "long" * 10, "x\n"]
    for most in (1, 3, 7, 100):
        cut = [p for batch in lines._pieces(texts, most) for p in batch]
        for i, t in enumerate(texts):
            assert "\n".join(p[3] for p in cut if p[0] == i) == t.removesuffix("\n")
            assert all(t[:c].count("\n") == n and t[c : c + len(p)] == p for k, n, c, p in cut if k == i)
