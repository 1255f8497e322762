"""Votes of stopwords and letters for the natural language of short remarks."""

from __future__ import annotations

import re

# Frequent function words of each language, in lower case.
STOPWORDS = {
    "en": "the a an and or of to in on for with without is are was were be that this these those it its they what which how from by at as not only one please here i my you your can cannot if before after between same small first second covers compare write explain tests".split(),
    "de": "der die das den dem des ein eine einen einem einer und oder mit ohne für von zu zum zur auf ist sind war was wie er sie es nicht nur bei aus nach vor im am an als auch wird werden kurz ihrer ihre dieser diese folgende erste zweite vergleichen vergleicht prüft schreibe leere leeren".split(),
    "fr": "le la les un une des du de et ou avec sans pour par sur dans est sont ce cette ces il elle qu que qui ne pas plus au aux à son sa ses voici comparer compare premier second cas chemin vide petites écris explique brièvement vérifie".split(),
    "es": "el la los las un una unos unas y o con sin para por de del en es son este esta estos que qué no su sus al lo como más usando comparar compara primer segundo caso cubre camino vacía pequeñas escribe explica brevemente prueba función".split(),
    "pt": "o a os as um uma uns umas e ou com sem para por de do da dos das em no na nos nas é são este esta que não seu sua ao à como mais comparar compara primeiro segundo caso cobre caminho vazia pequenas escreva explique teste função verifica".split(),
    "ru": "и или в на с со без для по из от до это этот эта тест что как не он она оно они его её их к у о об при после сравнивает сравнить первый второй пустой кратко напиши объясни проверяет".split(),
}

# Letters that one of these languages has and the others lack.
LETTERS = {"de": "äöüß", "es": "ñ¿¡", "pt": "ãõ", "fr": "èêëîïœùû"}

_VOTES: dict[str, list[str]] = {}
for _lang, _words in STOPWORDS.items():
    for _word in _words:
        _VOTES.setdefault(_word, []).append(_lang)

WORD = re.compile(r"[^\W\d_]+(?:’[^\W\d_]+)?")
KANA = re.compile("[぀-ヿ]")
HAN = re.compile("[一-鿿]")


def vote(text: str, least: float = 1.5, lead: float = 1.25) -> str | None:
    """Language of text, or None where the votes are few or close.

    A stopword gives one vote, shared by the languages that have it; a letter that only
    one language has gives it half a vote. Kana decide for Japanese, Han without kana
    for Chinese, once they outnumber a tenth of the words.
    """
    words = WORD.findall(text.lower())
    kana, han = len(KANA.findall(text)), len(HAN.findall(text))
    if kana + han > max(1, len(words) / 10):
        return "ja" if kana else "zh"
    score = dict.fromkeys(STOPWORDS, 0.0)
    for word in words:
        langs = _VOTES.get(word)
        for lang in langs or ():
            score[lang] += 1 / len(langs)
        if "а" <= word[0] <= "я":
            score["ru"] += 0.3
    lower = text.lower()
    for lang, letters in LETTERS.items():
        score[lang] += 0.5 * sum(lower.count(c) for c in letters)
    (first, a), (_, b) = sorted(score.items(), key=lambda x: -x[1])[:2]
    return first if a >= least and a >= lead * b else None
