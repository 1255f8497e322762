import random

import pytest

from codequarry.llm import encoding as E

SENTENCES = (
    "There’s a café-sized list of rows left to clean up…", "We don’t keep the naïve résumé in memory; it’s written to disk.", "La configuración del módulo se guardó después, así que también falló la contraseña.", "Für jede Größe führt der Läufer zusätzliche Prüfungen aus, die später schließen.",
    "Une fois la fenêtre créée, l’appel échoue dès que la référence dépasse le modèle.", "A versão do módulo não é mais lida após a execução, então a opção falhou.", "Исправлена память: раньше модуль обрабатывал её дважды и возвращал пустой список.", "Всего найдено много функций, из них часть без описания и проверки.",
    "この変更で関数の処理が短くなりました。引数が空の場合は返します。", "为什么模块要读取相同的索引？如果缓存为空，会抛出错误。",
)
KEPT = ("A lone `â€™` in the fixture is there on purpose.", 'The test feeds `"Ã©".encode("latin-1")` to the decoder.', "Placeholder for undecodable bytes is `\\ufffd`, shown as � in the viewer.", "ÂGE, FORÊT et HÔTEL restent en majuscules.", "Limits: ± 5 µs, 20 °C, cost £40 per ½ run.", "Emoji keys 🚀 and 🧪 are kept, as are Ω, ∑ and ≤.", "plain ascii", "", None)


def read_as(text, written, name):
    chars = {b: c for c, b in E.TABLES[name].items()}
    return "".join(chr(b) if b < 128 else chars[b] for b in text.encode(written))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    return [" ".join(rng.choices(SENTENCES, k=4)) for _ in range(400)] + [t for t in KEPT if t] * 3


@pytest.fixture(scope="module")
def fitted(spark, corpus):
    return E.fit(spark.createDataFrame([(t,) for t in corpus], "text string"), 100)


@pytest.mark.parametrize("name", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251"])
@pytest.mark.parametrize("k", range(len(SENTENCES)))
def test_utf8_read_wrongly_is_restored(fitted, name, k):
    model, margin = fitted
    if any(b not in {x: c for c, x in E.TABLES[name].items()} for b in SENTENCES[k].encode("utf-8") if b > 127):
        pytest.skip("the encoding has no character for a byte")
    bad = read_as(SENTENCES[k], "utf-8", name)
    good, chains = E.repair(model, bad, margin)
    assert good == SENTENCES[k] and chains


@pytest.mark.parametrize("k, written, name", [(6, "cp1251", "latin-1"), (7, "cp1251", "cp1252"), (8, "shift_jis", "cp1252"), (6, "cp866", "cp1251"), (7, "koi8-r", "cp1251"), (2, "latin-1", "mac_roman")])
def test_other_chains(fitted, k, written, name):
    model, margin = fitted
    text = " ".join([SENTENCES[k]] * 2)
    assert E.repair(model, read_as(text, written, name), margin)[0] == text


def test_double_encoding(fitted):
    model, margin = fitted
    bad = read_as(read_as(SENTENCES[0], "utf-8", "cp1252"), "utf-8", "cp1252")
    assert E.repair(model, bad, margin)[0] == SENTENCES[0]


def test_clean_text_stays(fitted, corpus):
    model, margin = fitted
    for t in corpus[:60] + [t for t in KEPT if t]:
        assert E.repair(model, t, margin) == (t, "") and not E.lost(t)


def test_held_out_accuracy(fitted):
    model, margin = fitted
    rng = random.Random(12)
    words = [w for s in SENTENCES[:8] for w in s.split()]
    hits = n = 0
    for _ in range(200):
        text = " ".join(rng.choices(words, k=12))
        if text.isascii():
            continue
        bad = read_as(text, "utf-8", rng.choice(["cp1252", "latin-1", "mac_roman", "cp850"]))
        n += 1
        hits += E.repair(model, bad, margin)[0] == text
    assert hits >= 0.9 * n


def test_rows(spark, corpus):
    bad = read_as(SENTENCES[0], "utf-8", "cp1252")
    rows = [(1, bad, "m"), (1, bad, "m"), (2, "We don\ufffdt keep it.", None), (3, SENTENCES[0] + "\n\n" + read_as(SENTENCES[3], "utf-8", "latin-1"), None), *((100 + k, t, None) for k, t in enumerate(KEPT)), *((1000 + k, t, None) for k, t in enumerate(corpus))]
    df = spark.createDataFrame(rows, "doc_id long, text string, restored string")
    got = {r.doc_id: r for r in E.garbled_texts(df, 100).collect()}
    assert set(got) == {1, 2, 3} and got[1].restored == SENTENCES[0] and got[1].complete and not got[2].complete and got[2].chains == ""
    assert got[3].restored == SENTENCES[0] + "\n\n" + SENTENCES[3]
    assert E.garbled_texts(df.limit(0)).count() == 0


def test_a_short_garbled_stretch_in_long_foreign_text_is_restored(fitted):
    model, margin = fitted
    good = "引数が空の場合は返します" * 8 + "この変更で関{}の処理が短くなりました" + "引数が空の場合は返します" * 8
    assert E.repair(model, good.format(read_as("数", "utf-8", "cp1252")), margin)[0] == good.format("数")


def test_nothing_beyond_reach_could_gain_the_margin(fitted, corpus):
    model, _ = fitted
    rng = random.Random(8)
    bad = [read_as(s, w, n) for s in SENTENCES for w, n in (("utf-8", "latin-1"), ("utf-8", "koi8-r"), ("utf-8", "cp850")) if all(b < 128 or b in E.TABLES[n].values() for b in s.encode(w))]
    units = [a[: rng.randint(5, 40)] + b[: rng.randint(1, 12)] + c[: rng.randint(5, 40)] for a, b, c in (rng.choices([*SENTENCES, *bad], k=3) for _ in range(300))]
    for unit in [x for x in units if not x.isascii() and len(E.UNIT.match(x)[0]) == len(x)]:
        sums = [0.0, *model.logs(unit).cumsum().tolist()]
        for margin in (1.0, 3.0):
            reach = E.within_reach(unit, 0, sums, margin)
            if reach is None or reach is False:
                assert not E.best_step(model, unit, margin, "utf-8")[1] or reach is False
                assert reach is False or not E.best_step(model, unit, margin)[1]


def test_copies_of_one_text_dont_fill_the_sample(spark, corpus):
    once = list(dict.fromkeys(corpus))[:60]
    copied = [t for t in once for _ in range(40)]
    margins = [E.fit(spark.createDataFrame([(t,) for t in rows], "text string"), 60)[1] for rows in (once, copied)]
    fewer = E.fit(spark.createDataFrame([(t,) for t in copied], "text string").coalesce(1), 60)[1]
    assert margins[1] == fewer and abs(margins[0] - margins[1]) < 0.5
    texts = []
    real, E.sample_units = E.sample_units, lambda t: texts.extend(t) or []
    try:
        E.fit(spark.createDataFrame([(t,) for t in copied], "text string"), 60)
    finally:
        E.sample_units = real
    assert len(texts) == len(set(texts)) > 40


def test_the_margin_is_validated_on_every_clean_sentence(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(s.split(), k=6)) + f" {k}." for k, s in enumerate(rng.choices(SENTENCES[:8], k=2500))]
    texts += ["Ligne cassée : " + read_as(SENTENCES[4], "utf-8", "cp1252"), "ascii only", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    model, margin = E.fit(df)
    units = [u for t in dict.fromkeys(t for t in texts if t and E.is_clean(t)) for u in E.UNIT.findall(t) if not u.isascii()]
    whole = E.validated_margin(*E.sample_gains(model, list(dict.fromkeys(units))))
    assert margin == pytest.approx(whole, abs=1e-9) and whole != E.MARGIN
    # neither copies nor their places count
    assert E.corpus_margin(df.union(df.limit(900)).repartition(3), model) == margin
    assert E.corpus_margin(df.limit(0), model) == E.MARGIN


def test_contexts_have_the_gains_of_their_sentences(fitted, corpus):
    units = list(E.clean_units(corpus[:80])) + [f"{a} {b}" for a, b in zip(SENTENCES, SENTENCES[3:])]
    cut = [E.context(u) for u in units]
    for whole, short in zip(E.sample_gains(fitted[0], units), E.sample_gains(fitted[0], cut)):
        assert short == pytest.approx(whole, abs=1e-6)
    assert sum(map(len, cut)) < sum(map(len, units))


def test_quantiles_are_exact(spark):
    rng = random.Random(9)
    values = {True: [rng.gauss(0, 4) for _ in range(700)] + [-0.0, 0.0, 1e-300], False: [rng.choice([0.0, 0.5, 2.25, 7.0]) for _ in range(301)]}
    rows = [(b, int(k), n) for b, xs in values.items() for k, n in zip(E.order_keys(E.np.array(xs)), [1 + i % 3 for i in range(len(xs))])]
    df = spark.createDataFrame(rows, "broken boolean, key long, n long")
    for q in (0.0, 0.01, 0.5, 0.99, 1.0):
        got = E.quantiles(df, {True: q, False: q})
        for b, xs in values.items():
            assert got[b] == pytest.approx(E.np.quantile([x for i, x in enumerate(xs) for _ in range(1 + i % 3)], q), abs=1e-12)
    assert E.quantiles(df.where("broken"), {True: 0.5, False: 0.5}).keys() == {True}
