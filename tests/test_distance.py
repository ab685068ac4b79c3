"""Edit distances against the plain table of distances."""

import random

import numpy as np
import pytest

from quire.functions import distance
from quire.operators import evaluate


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


@pytest.mark.parametrize("symbols, long", [(2, 1024), (255, 1024), (256, 1024), (3000, 1024), (9, 40)])
def test_distances(symbols, long, monkeypatch):
    monkeypatch.setattr(distance, "LONG", long)
    r = random.Random(symbols)
    a = [[r.randrange(1, symbols + 1) for _ in range(r.choice([0, 1, 5, 63, 64, 65, 128, 130]))] for _ in range(60)]
    b = [list(x) if r.random() < 0.2 else [c for c in x if r.random() > 0.1] if r.random() < 0.5 else [r.randrange(1, symbols + 1) for _ in range(r.choice([0, 1, 64, 100]))] for x in a]
    flat = lambda rows: (np.array([c for x in rows for c in x], np.int64), np.array([len(x) for x in rows], np.int64))
    assert distance.distances(*flat(a), *flat(b)).tolist() == [plain(x, y) for x, y in zip(a, b)]


def test_page_metrics(spark):
    rows = [
        (0, "a  b\nc", "a b c"), (1, "", "x y"), (2, None, "z"), (3, "**bold** w\U0001f600rd", "bold word"), (4, "# Head $$x+y$$ [^1]: end", "Head *x+y* end"),
        (5, " <page_number>3</page_number> tail", "tail of"), (6, "漢字 one two", "漢 two one"), (7, "![Image: cat] seen", "seen"), (8, None, None),
    ]
    content = {3: ("bold w\U0001f600rd", "bold word"), 4: ("Head x+y end", "Head x+y end"), 5: ("tail", "tail of"), 7: ("seen", "seen")}
    got = {r.id: r for r in evaluate.page_metrics(spark.createDataFrame(rows, "id int, ref string, hyp string"), ["id"]).collect()}
    for i, ref, hyp in rows:
        r, h = (" ".join((x or "").split()) for x in (ref, hyp))
        c, d = content.get(i, (r, h))
        assert (got[i].char_distance, got[i].word_distance, got[i].ref_chars, got[i].ref_words, got[i].hyp_words) == (plain(r, h), plain(r.split(), h.split()), len(r), len(r.split()), len(h.split())), i
        assert (got[i].content_char_distance, got[i].content_word_distance, got[i].content_ref_chars, got[i].content_ref_words) == (plain(c, d), plain(c.split(), d.split()), len(c), len(c.split())), i
    assert (got[3].ref_emphasis, got[4].ref_headings, got[4].hyp_emphasis, got[5].ref_pages) == (1, 1, 1, 1)


def test_more_words_in_a_pair_than_characters_can_stand_for(spark):
    words = [f"{i:x}" for i in range(36_000)]
    other = [*words[:-3], words[-1], words[-3]]
    m = evaluate.page_metrics(spark.createDataFrame([(" ".join(words), " ".join(other))], "ref string, hyp string"), []).first()
    assert (m.word_distance, m.ref_words, m.hyp_words) == (3, 36_000, 35_999)
