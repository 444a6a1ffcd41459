import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioscope.llm import languages, page_noise, personal, subjects
from folioscope.llm.boosting import Boosted

SENTENCES = {
    "en": "The committee has decided that the delivery will be made before the end of the week. We were told about it yesterday.",
    "de": "Der Ausschuss hat entschieden, dass die Lieferung vor dem Ende der Woche erfolgen wird. Wir wurden gestern darüber informiert.",
    "fr": "Le comité a décidé que la livraison sera effectuée avant la fin de la semaine. Nous en avons été informés hier.",
    "es": "El comité ha decidido que la entrega se hará antes del fin de la semana. Nos informaron de ello ayer por la tarde.",
    "ar": "قررت اللجنة أن يتم التسليم قبل نهاية الأسبوع. وقد تم إبلاغنا بذلك أمس في الاجتماع.",
}


@pytest.fixture(scope="module")
def profiles():
    return languages.fit_rows(pd.DataFrame({"text": [s for s in SENTENCES.values()] * 3, "label": [*SENTENCES] * 3}))


def test_languages(profiles):
    found = languages.decide(profiles, [*SENTENCES.values(), SENTENCES["en"] + " " + SENTENCES["ar"], None, "", "12345 678", SENTENCES["en"] * 500, "漢字"])
    assert [f[0] for f in found[:5]] == [*SENTENCES] and found[5][0] == "ar-en" and found[9][0] == "en"
    assert [f[0] for f in found[6:9]] == [None] * 3 and all(0 <= f[1] <= 1 for f in found)


def test_label_names():
    assert languages.label_set("en_US") == languages.label_set("English") == {"en"} and languages.label_set("EN-FR") == {"en", "fr"} and languages.label_set("ar,en") == {"ar", "en"}
    assert languages.label_set(" und ") is languages.label_set(None) is languages.label_set("") is None
    assert languages.mended("die KÃ¼ste") == "die Küste"


def test_names_and_addresses_bear_no_language():
    assert not languages.bears_language("Wilhelmina Kulamupin-Samupores, 41 Furani Avenue, Kevadiford") and languages.bears_language("lives at 41 Furani Avenue since then")


def test_trigram_sums_are_vector_products(profiles):
    text = SENTENCES["fr"]
    codes, _ = languages.trigrams([text])
    bundle = languages.vectors(profiles.letters, codes).sum(0)
    counts = np.unique(codes, return_counts=True)[1]
    found = profiles.segments([text])[0][0]
    assert np.allclose(bundle @ profiles.prototypes.T / np.sqrt(languages.DIMENSIONS) / np.sqrt((counts**2).sum()), found, atol=1e-3)
    # the cosine with the bundle itself, whose trigrams are nearly orthogonal
    assert np.allclose(bundle @ profiles.prototypes.T / np.linalg.norm(bundle), found, atol=0.02)


def test_training_runs_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(languages, "TRAINING_RUNS", 50)
    rows = spark.createDataFrame([(f"word{i} " * 400, "en") for i in range(20)] + [("x" * 5000, "de"), (" ", "de")], "text STRING, label STRING")
    found = languages._sample(rows)
    assert sum(len(languages.windows([t])) for t in found["text"]) <= 50 + len(found) and set(found["label"]) == {"en"}


def test_wrong_labels(spark, profiles):
    rows = [("documents", 1, 0, 0, "fr", SENTENCES["de"]), ("documents", 2, 0, 0, None, SENTENCES["es"]), ("documents", 3, 0, 0, "English", SENTENCES["en"]), ("documents", 4, 0, 0, None, "ok"), ("documents", 5, 0, 0, None, None)]
    frame = spark.createDataFrame(rows, "tbl STRING, doc_id BIGINT, page_number INT, detection_order INT, label STRING, text STRING")
    found = languages.wrong_labels(languages.label_texts(frame, profiles)).collect()
    assert {(r.doc_id, r.lang) for r in found} == {(1, "de"), (2, "es")}
    segments = languages.segment_texts(frame, profiles).collect()
    assert {r.lang for r in segments if r.doc_id == 1} == {"de"} and all(0 <= r.confidence <= 1 for r in segments)


def test_boosting_learns_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = (x[:, 0] > 0) & (x[:, 1] < 0.5)
    p = Boosted().fit(x[:2000], y[:2000]).probability(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.95 and Boosted().fit(x, y).probability(np.empty((0, 4))).size == 0


PAGE = """Review of Site Services 2021 | 4
The responsible department confirmed that the northern depot will be replaced toge-
ther with the visitor register. We recom¬
mend keeping the follow-
up meeting under obser\xadvation until rel1able comp@risons become possible.
The d e p a r t m e n t  of Katherine Samupores​ has moved to Kebofe Road.
Morvex Lindqual Ltd
- 4 -"""


@pytest.fixture(scope="module")
def lexicon():
    words = "the responsible department confirmed that northern depot will be replaced together with visitor register we recommend keeping follow-up meeting follow up under observation until reliable comparisons become possible of has moved to road".split()
    return page_noise.learn({w: 400 + 7 * i for i, w in enumerate(words)}, {"samupores": True, "kebofe": True, "katherine": True}, frozenset({"review of site services"}), frozenset({"morvex lindqual ltd"}))


def test_page_noise(lexicon):
    page = page_noise.read_page(lexicon, 2, PAGE, set())
    kinds = {i + 1: k for i, k in enumerate(page.kinds) if k}
    assert kinds == {1: {"running_head", "page_number"}, 2: {"hyphen"}, 3: {"hyphen"}, 5: {"misread"}, 6: {"misread"}, 7: {"running_head"}, 8: {"page_number"}}
    text = page.paragraphs()
    assert len(text) == 1 and "replaced together with" in text[0] and "reliable comparisons" in text[0] and "The department of Katherine Samupores" in text[0] and "Morvex" not in text[0]


def test_page_noise_edges(spark):
    schema = "doc_id BIGINT, page_number INT, raw_text STRING, kind STRING"
    rows = [(1, 1, None, "x"), (2, 1, "", "x"), (3, 1, "\n\n", "x"), (4, 1, "word " * 30_000, "x"), (5, 1, PAGE, "x"), (5, 1, PAGE, "x")]
    found = page_noise.noisy_lines(spark.createDataFrame(rows, schema)).collect()
    assert {(r.doc_id) for r in found} <= {5} and len(found) == len({(r.doc_id, r.line_no, r.kind) for r in found})
    assert page_noise.noisy_lines(spark.createDataFrame([], schema)).count() == 0
    assert {r.doc_id for r in page_noise.paragraphs(spark.createDataFrame(rows, schema)).collect()} == {4, 5}


def test_ocr_costs():
    assert page_noise.ocr_cost("confirrned", "confirmed") == pytest.approx(0.3) and page_noise.ocr_cost("a^b", "ab") == pytest.approx(0.3) and page_noise.ocr_cost("cat", "dog") > 2


TEXTS = [
    ("letter", "Please contact Katherine SAMUPORES on 0044-20-7946-0187 if the parcel is missing.", {("NAME", "Katherine"), ("PHONE", "0044")}),
    ("letter", "Copies were sent to samuel+post [at] mail [dot] example and to the archive. Order 0358-40867 was closed under lot 2010814 47.", {("EMAIL", "samuel")}),
    ("letter", "The tenant, Samupores, Katherine, has lived at 12 Repivo Road,\nDosapeford, 10613 since. Article 4626.564 costs 12.50 each.", {("NAME", "Samupores"), ("ADDRESS", "12 Rep")}),
    ("id_card", "IDENTITY CARD\nName: Dr. Quentin Farenifin\nNo. 42 Fobafo Avenue,10000\n2870626 8818524\nDate of birth 26/06/1987", {("NAME", "Quentin"), ("ADDRESS", "No. 42"), ("ID_NUMBER", "2870626")}),
    ("passport", "PASSPORT\nSurname / Nom: SAMUPORES\nGiven names: KATHERINE\nPassport No: XA9630854\nP<XQASAMUPORES<<KATHERINE<<<<<<<<<<<<<<<<<<<\nXA96308541XQA1057974F2512177<<<<<<<<<<<<<<06", {("NAME", "SAMUPORES"), ("NAME", "KATHERINE"), ("ID_NUMBER", "XA9630854\n"), ("NAME", "SAMUPORES<<"), ("ID_NUMBER", "XA96308541")}),
    ("receipt", "Zelkan Foods\nTicket # 21813\n1555374702\nlamp oil 17.10\nTotal 981.07", set()), ("cv", "", set()), ("cv", None, set()), ("report", "x" * 100_000, set()),
]


WORDS = "please contact the on if parcel is missing copies tenant has lived at since".split()


@pytest.mark.parametrize("copies", [1, 60])
def test_personal_information(copies):
    """On few pages what tells of proposals decides, on more the trees."""
    finder = personal.train(personal.Finder(frozenset({"katherine", "quentin"}), frozenset(WORDS)), [(t, p, {}) for p, t, _ in TEXTS if t and len(t) < 1000] * copies)
    assert (finder.trees is not None) == (copies > 1)
    for (paper, text, expected), items in zip(TEXTS, finder.items([(t, p) for p, t, _ in TEXTS])):
        assert len(items) == len(expected), (text, items)
        for kind, begin in expected:
            assert any(k == kind and text[a:].startswith(begin) for k, a, _ in items), (kind, begin, items)


def test_extracted_values_teach_the_trees():
    """A number in no known way of writing is an item where the values extracted from such pages say so."""
    rnd = random.Random(3)
    number = lambda: f"{rnd.randrange(100, 999)} {rnd.randrange(1000, 9999)} {rnd.randrange(10, 99)}"
    pages = []
    for _ in range(300):
        a, b = number(), number()
        pages.append((f"desk box {a}\nmember {b} here\n", "letter", {"".join(filter(str.isdigit, b)): "ID_NUMBER"}))
    finder = personal.train(personal.Finder(frozenset(), frozenset(["member"])), pages)
    # the words before differ only in being cues of nothing, so the place in the line tells
    assert finder.trees is not None and set(finder.thresholds) <= set(personal.TYPES)


def test_views_keep_positions():
    text = "a \u200bb\u00a0 \n  c\u0663\td"
    view = personal.View(text)
    assert view.text == "a b\nc3 d" and [text[i] for i in view.at[:-1]] == ["a", " ", "b", "\n", "c", "\u0663", "\t", "d"]
    assert personal.View("").text == "" and personal.View(" ").text == " "


def test_redaction(spark):
    rows = [(1, 1, t, t, None, "passport") for p, t, _ in TEXTS if p == "passport"] + [(2, 1, None, "", " ", "letter")]
    pages = spark.createDataFrame(rows, "doc_id BIGINT, page_number INT, text STRING, raw_text STRING, normalized_text STRING, document_type STRING")
    out = {r.doc_id: r for r in personal.redact(pages).collect()}
    assert "SAMUPORES" not in out[1].text and out[1].text.startswith("PASSPORT\nSurname / Nom: [NAME]\nGiven names: [NAME]") and out[2].raw_text == "" and out[2].text is None
    assert personal.find(pages.limit(0)).count() == 0


def test_subjects(spark):
    rnd = random.Random(0)
    nouns = {"law": "verdict statute notary plaintiff".split(), "cooking": "broth saucepan marinade dough".split(), "music": "choir chord melody violin".split()}
    about, other = ["The {} is explained step by step.", "I finally understood the {} after trying it twice.", "There is far too little about the {}."], ["It broke within a week.", "The lid came torn and sticky.", "My aunt would buy it again."]

    def text(*kinds):
        parts = [rnd.choice(about).format(rnd.choice(nouns[k])) for k in kinds for _ in range(3)] + rnd.sample(other, 2)
        rnd.shuffle(parts)
        return " ".join(parts)

    examples = spark.createDataFrame([(text(k), k, "en") for k in nouns for _ in range(25)], "text STRING, subject STRING, lang STRING")
    docs = [(i, text(*kinds), kinds) for i, kinds in enumerate([(k,) for k in nouns for _ in range(30)] + [("law", "music")] * 10)]
    rows = [(i, t, "clash") for i, t, _ in docs] + [(900, None, ""), (901, "", ""), (902, "It broke.", ""), (903, "The verdict is good.", "")]
    frame = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, subject STRING")
    found = {}
    for r in subjects.assign(frame, subjects.mine(frame, examples)).collect():
        found.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(found.get(i, set()) == set(kinds) for i, _, kinds in docs)
    assert right >= 0.95 * len(docs) and not found.keys() & {900, 901, 902, 903}


def test_candidates_are_all_words_within_the_cost(spark, lexicon):
    vocabulary = {*lexicon.counts, "com", "con", "cor", "car", "can", "cow", "cop", "cot", "cob", "cod", "coy", "until", "tanto"}
    wide = page_noise.Lexicon({w: 5 for w in vocabulary})
    words = ["cori", "corn", "uritii", "fanfo", "c^om", "xq", "confirrned", "ﬁ", "o"]
    found = {w: {wide._words[k]: c for k, c in zip(*near)} for w, near in zip(words, wide.near(words))}
    for read in words:
        expected = {w: page_noise.ocr_cost(read, w) for w in vocabulary if w != read and page_noise.ocr_cost(read, w) <= 2}
        assert found[read] == pytest.approx(expected)
    assert {"con", "com", "cor", "car", "can", "cow", "cop", "cot", "cob", "cod", "coy"} <= found["cori"].keys()
    # the joins give what the index on the driver gives
    rows = spark.createDataFrame(list(zip(wide._words, range(len(wide._words)))), "word STRING, place INT")
    joined = {}
    for r in page_noise.candidates(spark.createDataFrame([(w,) for w in words], "word STRING"), rows).collect():
        joined.setdefault(r.word, set()).add(r.place)
    assert joined == {w: set(wide._retrieve(w).tolist()) for w in words}
    for w in vocabulary:
        assert {c for c in page_noise.misread_once(w) if c in vocabulary and c != w} == {c for c in vocabulary if c != w and page_noise.ocr_cost(w, c) <= 0.35}


def test_strokes_and_tables_of_costs(spark):
    pairs = [(a, b) for group in page_noise.CONFUSED for a in group for b in group] + [(one, two) for one, every in page_noise.SPLIT.items() for two in every]
    assert all(page_noise.strokes(f"x{a}y") == page_noise.strokes(f"x{b}y") for a, b in pairs)
    words = ["", "will", "d^og", "kq9", "شمس", "a-b", "cj1"]
    rows = spark.createDataFrame([(w,) for w in words], "w STRING").select("w", page_noise.strokes_of(F.col("w")).alias("s"), page_noise.shorter_of(F.col("w")).alias("less")).collect()
    assert {(r.w, r.s) for r in rows} == {(w, page_noise.strokes(w)) for w in words} and all(set(r.less) == page_noise.shorter(r.w) for r in rows)
    rnd = random.Random(1)
    a, b = ([("".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 9)))) for _ in range(1500)] for letters in ("abcdehilmnorstuvwkdq^~'iil1rn", "abcdehilmnorstuvwkdq-"))
    assert page_noise.pair_costs(a, b).tolist() == [round(10 * page_noise.ocr_cost(x, y)) for x, y in zip(a, b)]
    assert page_noise.pair_costs(a, b, scanner=False).tolist() == [10 * page_noise.edit_distance(x, y) for x, y in zip(a, b)]


def test_words_of_copied_pages_count_once(spark):
    rows = [(i, 1, f"The confirrned order 10{i}\nwas sent to the housing office.") for i in range(60)]
    rows += [(100 + i, 1, f"Every {w} is confirmed here\nand {w} stays.") for i, w in enumerate(["window", "garden", "letter", "stone", "bridge", "river"])]
    lexicon, _ = page_noise.fit(spark.createDataFrame(rows, "doc_id BIGINT, page_number INT, raw_text STRING"))
    assert "confirmed" in lexicon.counts and "confirrned" not in lexicon.counts


def test_every_text_has_language_script_and_segments(spark):
    from folioscope.llm import queries

    d, keys = "/root/testdata/sf0.001", ["tbl", "doc_id", "page_number", "detection_order"]
    texts = queries.p1_texts(spark, d).toPandas()
    for name in ("documents", "doc_text", "blocks"):
        rows = spark.read.parquet(f"{d}/{name}.parquet").select(*(c for c in ("doc_id", "page_number", "detection_order") if name != "documents" and (c != "detection_order" or name == "blocks") or c == "doc_id")).distinct()
        assert len(texts[texts.tbl == name][keys].drop_duplicates()) == rows.count()
    assert {"latin", "arabic"} <= set(texts.script) and languages.script_of("اب a 1") == "arabic" and languages.script_of("12") is None
    assert set(queries.p1_segments(spark, d).select("tbl").distinct().toPandas().tbl) == {"documents", "doc_text", "blocks"}
