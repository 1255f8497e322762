import random

import pytest

from codequarry.llm import pairs as P
from codequarry.llm.stopwords import vote

CHAT = "array<struct<role:string,content:string>>"
SCHEMA = f"task_no long, chat_messages {CHAT}, generated_test string, tests map<string,string>, instruction string, response string"
TEST = "```python\nimport unittest\n\nclass T(unittest.TestCase):\n    def test_a(self):\n        # compare with the reference\n        self.assertEqual(f(1), g(1))\n```"
ASK = "Write a test using the `unittest` library for the function `f`. Only return the test code.\n\n```python\ndef f(x):\n    # adds one to the argument\n    return x + 1\n```"


def brute_cover(source, words, least):
    """Words in runs of at least `least` words that are runs of the source."""
    runs = {tuple(source[i:j]) for i in range(len(source)) for j in range(i + 1, len(source) + 1)}
    hit = set()
    for i in range(len(words)):
        for j in range(i + least, len(words) + 1):
            if tuple(words[i:j]) in runs:
                hit.update(range(i, j))
    return len(hit)


def test_suffix_automaton_against_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        source, words = rng.choices("abc", k=rng.randint(1, 12)), rng.choices("abcd", k=rng.randint(1, 12))
        least = rng.randint(1, 4)
        assert P.SuffixAutomaton(source).covered(words, least) == brute_cover(source, words, least)


def test_phrase_automaton_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        phrases = [rng.choices("abc", k=rng.randint(1, 3)) for _ in range(4)]
        words = rng.choices("abcd", k=rng.randint(0, 10))
        want = any(words[i : i + len(p)] == p for p in phrases for i in range(len(words)))
        assert P.PhraseAutomaton(phrases).accepts(words) == want


@pytest.mark.parametrize("response, kind", [
    (TEST, None), (TEST + "\n\nThe first case covers the ordinary path.", None), ("", "empty"), (" \t\xa0\u200b", "empty"), ("```python\n# YOUR CODE HERE\n```", "empty"), (None, "empty"), ("TODO", "empty"),
    (TEST[:-40], "truncated"), (TEST + "\n\nThe first case covers the", "truncated"), ("Here is a test that compares both.", "truncated"), ("import unittest\n\nclass T:\n    def test_a(self):\n        got = f(1)", "truncated"),
    ("I'm sorry, but I can't help with that request.", "refusal"), ("# Das darf ich nicht schreiben.", "refusal"), ("申し訳ありませんが、お応えできません。", "refusal"), ("Sorry for the missing branch; this test reaches it.\n\n" + TEST, None),
    (ASK, "copy"), (ASK.split("\n")[0].upper(), "copy"), ("> " + ASK.replace("\n", "\n> "), "copy"), ("```python\ndef f(x):\n    # adds one to the argument\n    return x + 1\n```\n\n" + TEST, None),
    ("Der folgende Test vergleicht die Funktion mit ihrer Referenz.\n\n" + TEST.replace("compare with the reference", "mit der Referenz vergleichen"), "other_language"), ("このテストは参照実装を比べます。\n\n" + TEST, "other_language"),
])
def test_defects(response, kind):
    assert P.defect(ASK, response) == kind


@pytest.mark.parametrize("text, want", [
    ("The function does not close the file, so the test should look at that and", False), ("No case fails here, but the second one can", False), ("Ne compare pas les deux valeurs", False), ("Nicht jede Zahl ist gerade", False),
    ("My guidelines do not let me write that.", True), ("Dafür darf ich keinen Test schreiben", True), ("je ne peux pas vous aider", True), ("no puedo ayudar con esa petición", True), ("я не могу помочь", True), ("我无法协助完成这个请求。", True), ("Leider kann ich\ndabei nicht helfen.", True), ("I can help. It is not hard.", False),
])
def test_declining_needs_the_speaker_or_a_whole_phrase(text, want):
    assert P.declines(text) == want


def test_a_bare_negation_is_no_refusal():
    assert P.defect(ASK, "The function does not close the file, so the test should look at that and") == "truncated"


def test_votes():
    assert vote("comparar com a referência") == "pt" and vote("comparar con la referencia y el caso") == "es" and vote("") is None and vote("x = 1") is None and vote("сравнить с эталоном") == "ru" and vote("第一个用例检查常规路径") == "zh"


def test_rows(spark):
    rows = [
        (1, [("system", None), ("user", "old"), ("assistant", "x"), ("user", ASK)], None, {"b": "World", "a": "I can't do that, no."}, "i", "r"), (1, [("system", None), ("user", "old"), ("assistant", "x"), ("user", ASK)], None, {"b": "World", "a": "I can't do that, no."}, "i", "r"),
        (2, None, TEST, None, None, None), (3, [], None, None, None, None), (4, [(None, None), ("user", None)], TEST, {}, None, None), (5, [("user", ASK)], "x" * 300_000, None, None, None), (6, [("user", ASK)], None, {"a": None}, None, None),
    ]
    got = {r.task_no: r.defect for r in P.broken_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "refusal", 3: "empty", 5: "truncated", 6: "empty"} or got == {1: "truncated", 3: "empty", 5: "truncated", 6: "empty"}
    assert P.broken_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
