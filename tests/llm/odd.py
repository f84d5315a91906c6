"""Small tables with the odd cases, and plain reference versions of what the operators compute."""

from __future__ import annotations

import re

LONG = "lorem ipsum dolor sit amet. " * 4000
PASSAGE = "Alpha beta gamma delta one two three. Four five six seven eight nine ten eleven twelve. Words go on and on until fifty of them are here at last, more or less, as the case may be today."
TEXTS = [
    (1, "one two three four five six seven eight nine ten"), (2, "One two three four FIVE six seven eight nine ten"), (2, "One two three four FIVE six seven eight nine ten"), (3, None), (4, ""), (5, " \n\t "),
    (6, "one two"), (7, "one  two"), (None, "one two three four five six seven eight nine eleven"), (8, LONG), (9, LONG + "end"), (10, "a\nb\nc\nd\n\nx"), (11, "y\n a\nb \nc\nd\nz"), (12, "a\nb\nq"),
    (13, "r\nr\nr\nr\nr\nr\nr"), (14, PASSAGE), (15, "Intro here. " + PASSAGE + " Outro."), (16, "🙂 emoji 日本語 <|endoftext|> <|im_start|>\\"), (17, "b\nc\nd"), (18, "12 34 !!"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, ids int, shard int, lang_pred int, n_lines int, leaks int, component_id int, n_entities int"


def documents(spark, texts=TEXTS):
    """Documents with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, "s", len(t or ""), *[7] * 8) for i, t in texts], SCHEMA)


def components(nodes, links):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def segments(text, sentences):
    parts = re.split(r"(?<=[.!?])[\t-\r ]+|\n" if sentences else r"\n", text or "")
    return [p for x in parts if (p := x.strip(" \t\n\r\x0b\x0c"))]


def cut(rows, sentences, spans):
    """rows [(id, text)] in order -> {(id, text): (segments, removed, kept)}; a row that agrees with an earlier one is that one."""
    seen, out = {}, {}
    for key in dict.fromkeys(rows):
        x = segments(key[1], sentences)
        gone = set()
        for n, need in spans.items():
            for i in range(len(x) - n + 1):
                g = (n, *x[i : i + n])
                if sum(len(re.split(r"[\t-\r ]+", s)) for s in g[1:]) < need:
                    continue
                if g in seen:
                    at, j = seen[g]
                    gone.update(range(max(i, j + n) if at == key else i, i + n))
                else:
                    seen[g] = (key, i)
        out[key] = len(x), len(gone), [s for i, s in enumerate(x) if i not in gone]
    return out
