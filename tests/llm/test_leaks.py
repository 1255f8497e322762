import random

import numpy as np
import pytest

from codequarry.llm import leaks as L


def brute_passage(doc, item):
    """Longest passage over all starts: equal length, at most one in nine replaced, matches at both ends."""
    best = 0
    for i in range(len(item)):
        for p in range(len(doc)):
            missed, n = 0, 0
            while i + n < len(item) and p + n < len(doc):
                missed += item[i + n] != doc[p + n]
                n += 1
                if item[i] == doc[p] and item[i + n - 1] == doc[p + n - 1] and L.PER_REPLACED * missed <= n:
                    best = max(best, n)
    return best


def test_found_like_brute_force():
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(60)]
    for _ in range(60):
        item = rng.choices(vocabulary, k=40)
        a = rng.randint(0, 15)
        part = item[a : a + rng.randint(12, 25)]
        for k in range(len(part)):
            if rng.random() < rng.choice([0, 0.08, 0.15]):
                part[k] = "zz"
        doc = rng.choices(vocabulary, k=15) + part + rng.choices(vocabulary, k=15)
        got = [x for x in L.ItemIndex([(1, " ".join(item))]).leaks([" ".join(doc)])]
        want = brute_passage(doc, item)
        assert bool(got) == (want >= L.PASSAGE)
        if got:
            assert got[0][2] == want


def test_tiling_catches_reordered_parts():
    item = np.arange(1, 41, dtype=np.uint64)
    doc = np.concatenate([item[20:40], np.zeros(3, np.uint64), item[:20]])
    assert L.tiling(doc, item, [-20, 23]) == [(20, 0, 23, 0), (20, 20, 0, 0)]
    assert L.longest_match(doc, item, -20)[0] == 20


def brute_tiling(doc, item, least):
    """Tiles by looking at all pairs of free stretches again and again."""
    free_doc, free_item, tiles = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for p in range(len(doc)):
                missed, n = 0, 0
                while i + n < len(item) and p + n < len(doc) and free_item[i + n] and free_doc[p + n]:
                    missed += item[i + n] != doc[p + n]
                    n += 1
                    if item[i] == doc[p] and item[i + n - 1] == doc[p + n - 1] and L.PER_REPLACED * missed <= n and (-n, i, p - i) < (-best[0], best[1], best[2] - best[1]):
                        best = (n, i, p)
        if best[0] < least:
            return tiles
        n, i, p = best
        tiles.append((n, i, p, sum(item[i + k] != doc[p + k] for k in range(n))))
        free_item[i : i + n] = [False] * n
        free_doc[p : p + n] = [False] * n


def test_tiling_against_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        doc, item = rng.choices([1, 2, 3, 4], k=rng.randint(1, 26)), rng.choices([1, 2, 3, 4], k=rng.randint(1, 22))
        offsets = range(-len(item) + 1, len(doc))
        assert L.tiling(np.array(doc, np.uint64), np.array(item, np.uint64), offsets, 2) == brute_tiling(doc, item, 2)


def test_reordered_item_is_a_leak_without_a_passage(spark, monkeypatch):
    words = [f"word{k}" for k in range(72)]
    pieces = [words[a : a + 17] for a in range(0, 68, 17)]
    text = " between ".join(" ".join(x) for x in reversed(pieces))
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(1, text), (2, " ".join(pieces[0])), (3, " ".join(words[20:40]))], "doc_id long, text string")
    got = {r.doc_id: r for r in L.leaked_items(docs, items).collect()}
    assert set(got) == {1, 3} and (got[1].passage_words, got[1].tiles, got[1].covered_words) == (17, 4, 68)
    assert [tuple(r) for r in L.passages(docs, items).collect()] == [(3, 1)]


def test_nothing_is_found_without_tiles(monkeypatch):
    monkeypatch.setattr(L, "tiling", lambda *_: [])
    assert list(L.ItemIndex([(5, ITEM)]).leaks([ITEM])) == []


ITEM = "Given twelve brass bottles, pick_one has to choose the lonely cork where any ring counts once it has been lifted for 46 days before the gate closes"


@pytest.mark.parametrize("text", [
    ITEM.upper(), "  ".join(ITEM.split()), "# " + ITEM.replace(" has", "\n#  has"), "> " + ITEM.replace(",", "&#44;").replace(" any", "&nbsp;any"), '{"p": "' + ITEM.replace(" cork", "\\ncork").replace("b", "\\u0062") + '"}', ITEM.replace(" ", "%20"), "x " * 5000 + ITEM,
    ITEM.replace("_", "\\_").replace(",", "\\,"), ITEM.replace("lonely", "single"), ITEM.replace(",", " ;").replace(".", ""),
])
def test_layout_does_not_matter(text):
    assert [x[:2] for x in L.ItemIndex([(5, ITEM)]).leaks([text])] == [(0, 5)]


@pytest.mark.parametrize("text", [" ".join(ITEM.split()[:17]), " ".join(w if k % 5 else "other" for k, w in enumerate(ITEM.split())), "", "pick_one", " ".join(reversed(ITEM.split()))])
def test_no_leak(text):
    assert list(L.ItemIndex([(5, ITEM)]).leaks([text])) == []


def test_rows_and_blocks(spark):
    items = spark.createDataFrame([(k, f"{ITEM} number {k} and so on {k * 7}", "s") for k in range(6)] + [(77, None, None), (78, "", None), (0, f"{ITEM} number 0 and so on 0", "s")], "item_id long, text string, doc_id string")
    docs = spark.createDataFrame([(1, f"see {ITEM} number 3 and", "x"), (1, f"see {ITEM} number 3 and", "x"), (2, None, None), (3, "", None), (4, "nothing here", None)], "doc_id long, text string, item_id string")
    want = {(1, k) for k in range(6)}
    for block in (1 << 20, 400):
        assert {(r.doc_id, r.item_id) for r in L.leaked_items(docs, items, block).collect()} == want
    best = max(L.leaked_items(docs, items).collect(), key=lambda r: (r.passage_words, -r.replaced_words))
    assert best.item_id == 3 and best.coverage <= 1.0
    assert L.leaked_items(docs.limit(0), items).count() == 0 and L.leaked_items(docs, items.limit(0)).count() == 0
