import random

import pytest
from pyspark.sql import functions as F

from foliomill.plans import runtime
from foliomill.llm import closing, labelmodel, language, p1_truncation, p2_pairs, shingles

import numpy as np

SENTENCES = ["The remaining error is explained by the clinical sensor rather than by the neural parser.", "We compare the porous assay with a hybrid vaccine in field plots.", "Each nested genome was reviewed by two readers, who agreed in 44 % of the cases.", "The authors report a viral sampling of 2.08 and a coupled embedding of 3.3 %."]
ITEMS = "- use of a clinical sensor and a neural parser\n- tables about the porous assay\n- discussion of the hybrid vaccine\n- tables about the nested genome"
PROSE = " ".join(SENTENCES * 6)


@pytest.fixture(scope="module")
def model():
    closes, total = np.zeros(closing.SLOTS), np.zeros(closing.SLOTS)
    words = ["sensor", "parser", "assay", "vaccine", "genome", "embedding"]
    more = [PROSE] * 60 + [ITEMS] * 40 + [f"Keywords: clinical {a}, neural {b}, porous {c}" for a in words for b in words for c in words]
    for (kind, key, yes), n in closing.evidence(more).items():
        closes[closing.slot(kind, key)] += n * yes
        total[closing.slot(kind, key)] += n
    return closes, total


@pytest.mark.parametrize(
    "text",
    [None, "", "  \n", "...", "No.", "null", SENTENCES[0], SENTENCES[3], PROSE + " 🙂", "“" + SENTENCES[1] + "”", ITEMS, "Keywords: clinical sensor, neural parser, porous assay", '[{"cue": "a", "category": "b"}]', '```json\n[{"cue": "a"}]\n```', '{"a": "b [ \\" {"}', "Two panels.", "About 3 %.", "Task: Describe the sensor, and the parser.\n\nUse neutral wording.\n\nANSWER:"],
)
def test_whole(model, text):
    assert closing.score(text, *model) >= closing.CUTOFF


@pytest.mark.parametrize(
    "text",
    [PROSE[:-20], PROSE[:-20] + "…", PROSE[:-20] + " [...]", PROSE[:-9] + "�", SENTENCES[0][:-30], ITEMS[:-4], ITEMS + "\n- use of a clinical", "Keywords: clinical sensor, neur", '[{"cue": "a", "category": "b"}, {"cue": "c', '```json\n[{"cue": "a"}]', '```json\n[{"cue": "a"', '{"claims": [', PROSE + " Earlier work (Marsev et al."],
)
def test_cut(model, text):
    assert closing.score(text, *model) < closing.CUTOFF


def test_near_copy_alignment():
    long = " ".join(f"w{i}" for i in range(100)) + "."
    assert p1_truncation.ending(" ".join(f"w{i}" for i in range(85)), long) == 1
    assert p1_truncation.ending(" ".join(f"w{i}" if i != 40 else "x" for i in range(85)) + "…", long) == 1
    assert p1_truncation.ending(" ".join(f"w{i}" for i in range(30)) + " w3", long) == 1
    assert p1_truncation.ending(long, long) == 0 == p1_truncation.ending("", long)
    assert p1_truncation.ending(" ".join(f"v{i}" for i in range(85)), long) == 0
    assert p1_truncation.ending(PROSE[: PROSE.index("We compare") - 1], PROSE) == 2  # a sentence ends here
    assert p1_truncation.ending("Keywords: clinical sensor, neural parser", "Keywords: clinical sensor, neural parser, porous assay") == 2
    assert p1_truncation.ending("Keywords: clinical sensor, neural", "Keywords: clinical sensor, neural parser, porous assay") == 1
    assert p1_truncation.ending(ITEMS.rsplit("\n", 1)[0], ITEMS) == 2 and p1_truncation.ending(ITEMS[:-7], ITEMS) == 1


def test_signatures_find_cut_copies():
    base = [f"w{i}" for i in range(120)]
    a, b = " ".join(base), " ".join(base[:40])
    counts, _, bands, _ = shingles.signatures([a, b, None, "", "few words"])
    own = shingles.own_level(counts[1])
    assert (bands[0][own] == bands[1][own]).all() and bands[2:] == [None, None, None] and len(bands[0]) == 2
    assert shingles.containment(b, a) == 1.0 and shingles.own_level(8) == -1


def planted(rng, n=250):
    """Whole texts of 30 to 150 words, and of each a copy cut anywhere after its tenth word, every third with a word changed."""
    words = "clinical sensor neural parser porous assay hybrid vaccine nested genome viral sampling coupled embedding lateral filament".split()
    whole, cut = [], []
    for _ in range(n):
        x = [rng.choice(words) + str(rng.randrange(300)) for _ in range(rng.randrange(30, 150))]
        for k in range(9, len(x), 10):
            x[k] += "."
        x[-1] = x[-1].rstrip(".") + "."
        text = " ".join(x)
        at = rng.randrange(len(" ".join(x[:12])), len(text) - 3)
        y = text[:at].split(" ")
        if rng.random() < 0.33 and len(y) > 14:
            y[rng.randrange(9, len(y) - 2)] = "changed"
        whole.append(text)
        cut.append(" ".join(y))
    return whole, cut


def test_matching_finds_planted_copies(spark):
    """Without any terminality: at least nine in ten cut copies are matched, and the alignment knows which end inside a sentence."""
    whole, cut = planted(random.Random(3))
    rows = list(enumerate(whole)) + [(1000 + i, x) for i, x in enumerate(cut)]
    counts, _, bands, maps = shingles.signatures([x for _, x in rows])
    lanes = [f"lane_{k}" for k in range(shingles.LANES)]
    sig = [(k, n, k >= 1000, b.ravel().tolist(), shingles.own_level(n), *map(int, m)) for (k, _), n, b, m in zip(rows, counts, bands, maps)]
    sig = spark.createDataFrame(sig, f"key long, words int, open boolean, bands array<int>, level int, {', '.join(f'{c} long' for c in lanes)}")
    got = {r["key"]: r for r in p1_truncation.early_copies(spark.createDataFrame(rows, "key long, text string"), sig, "key").collect()}
    assert sum(got[k]["partner"] == k - 1000 for k in got) >= 0.9 * len(cut)
    wrong = [k for k in got if got[k]["inside"] == (cut[k - 1000].endswith("."))]
    assert len(wrong) <= 0.02 * len(cut), [cut[k - 1000][-30:] for k in wrong]


@pytest.mark.parametrize("broadcast", [True, False])
def test_matching_decides(spark, monkeypatch, broadcast):
    """List items cut after a word that may well close an item: only the full copies tell, whether sides are broadcast or shuffled."""
    if not broadcast:
        monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)
    items = [f"- tables about the porous assay\n- discussion of the hybrid vaccine\n- use of case {i} in plot {i} with a clinical sensor and a neural parser\n- study of the nested genome for site {i} from the lateral field plots" for i in range(30)]
    cut = [x[: x.index(" for site")] for x in items]
    rows = [(i, "A", x, 50, "x") for i, x in enumerate(items)] + [(100 + i, "A", x, 50, "x") for i, x in enumerate(cut[:10])]
    rows += [(200 + i, "A", f"- study of the nested genome\n- tables about the lateral genome\n- discussion of case {i}", 30, "x") for i in range(30)]
    df = spark.createDataFrame(rows, "result_id long, source string, text string, generated_tokens int, inside string")
    found = lambda **k: {r["result_id"] for r in p1_truncation.truncated(df, **k).filter("truncated").collect()}
    assert found() - found(match=False) == set(range(100, 110))


def test_tokens_are_a_hint(spark):
    """A closing that is neither sure nor doubtful counts as cut if far more tokens were spent than such a text has."""
    plain = [(i, "A", f"The sensor was kept in plot {i}. {SENTENCES[1]}", 20, "x") for i in range(200)]
    rows = plain + [(1000, "A", "It remains open whether the nested genome and the porous assay", 14, "x"), (1001, "A", "It remains open whether the nested genome and the porous assay", 90, "x"), (1002, "A", "It remains open whether the nested genome and the porous assay", None, "x"), (1003, "A", SENTENCES[0], 900, "x")]
    df = spark.createDataFrame(rows, "result_id long, source string, text string, generated_tokens int, chars string")
    got = {r["result_id"]: r for r in p1_truncation.truncated(df, match=False).collect()}
    assert not got[1003]["truncated"] and got[1000]["terminality"] == got[1001]["terminality"]
    assert got[1001]["truncated"] >= got[1000]["truncated"] == got[1002]["truncated"]


def test_truncated(spark):
    whole = PROSE
    rows = [(1, "A", whole, 90, "x"), (1, "A", whole, None, "x"), (2, "A", whole[:-25], 90, "x"), (3, None, None, 9, "x"), (4, "B", "", None, "x"), (5, "B", "Yes.", 1, "x"), (6, "B", '[{"cue": "a', 5, "x"), (None, "B", whole, 90, "x")]
    # Near-copies of one text hold more than a third of the rows.
    rows += [(100 + i, "C", f"{whole} Case {i} ends here.", 90, "x") for i in range(20)]
    df = spark.createDataFrame(rows, "result_id long, source string, text string, generated_tokens int, key string")
    got = {r["result_id"]: r["truncated"] for r in p1_truncation.truncated(df).collect()}
    assert len(got) == 26 and {k for k, v in got.items() if v} == {2, 6}
    assert p1_truncation.truncated(df.limit(0)).count() == 0


def test_large_buckets_are_joined_in_blocks(spark, monkeypatch):
    """A third of the texts begin alike; each of their cut copies finds its own."""
    monkeypatch.setattr(p1_truncation, "BLOCK", 7)
    head = " ".join(f"h{i}" for i in range(10))
    rows = [(i, "A", f"{head} {' '.join(f'w{i}x{j}' for j in range(30))}.", 60, "x") for i in range(60)]
    rows += [(100 + i, "A", rows[i][2][:-40], 60, "x") for i in range(20)]
    df = spark.createDataFrame(rows, "result_id long, source string, text string, generated_tokens int, block string")
    got = {r["result_id"]: r["partner"] for r in p1_truncation.truncated(df).collect()}
    assert {k: v for k, v in got.items() if v is not None} == {100 + i: i for i in range(20)}


def test_language():
    assert language.expected("Describe the sensor.\n\nGive the answer in German.") == "de"
    assert language.expected("Résumez le passage qui porte sur la mesure.\n\nPAPER:\nLa valeur était de 3.") == "fr"
    assert language.expected("¿Qué muestra la figura dedicada a la estructura del campo?") == "es"
    assert language.by_words("")[0] is None


def test_label_model_recovers_classes():
    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.08
    accuracy = [0.95, 0.85, 0.75]
    votes = np.stack([np.where(rng.random(len(y)) < a, y, ~y) * 2 - 1 for a in accuracy], axis=1)
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = labelmodel.fit(patterns, counts)
    post = model.posterior(patterns)
    some = rng.permutation(len(y))[:500]
    cut = labelmodel.validated_cutoff(post[where.ravel()][some], y[some], model.share)
    hit = post[where.ravel()] >= cut
    precision, recall = (hit & y).sum() / hit.sum(), (hit & y).sum() / y.sum()
    assert cut >= 0.5 and precision > 0.75 and recall > 0.6
    assert len(labelmodel.fit(np.empty((0, 3)), np.empty(0)).posterior(np.empty((0, 3)))) == 0
    assert labelmodel.validated_cutoff(np.array([0.9, 0.6, 0.2]), np.array([True, False, False]), 0.3) == pytest.approx(0.75)


PROMPT = "Describe how the clinical sensor is presented in this paper.\n\nUse neutral wording."
FR_TEXT = FR = "La figure 9 illustre la réponse de la densité osseuse en fonction du temps. Nous recommandons donc la mesure du béton armé avant toute intervention dans les unités de soins."


def pairs_tables(spark):
    prompts = [(f"q{i}", PROMPT, 500, "z") for i in range(60)] + [("qn", None, 500, "z"), ("qf", "Résumez le passage qui porte sur la mesure du champ.\n\nSoyez précis.", 500, "z")]
    cases = {1: "[]", 2: "I'm sorry, but I can't help with this request.", 3: "DESCRIBE HOW THE CLINICAL SENSOR IS PRESENTED IN THIS PAPER.", 4: FR, 5: PROSE[:-25], 6: None, 7: "Leider kann ich diese Anfrage nicht beantworten.", 8: PROMPT.split("\n")[0] + " " + PROSE, 9: '{"cues": [], "note": "As a language assistant, I cannot access the attached figure."}'}
    results = [(i, f"q{i}", x, 90, "z") for i, x in cases.items()] + [(1, "q1", "[]", 90, "z"), (50, "qn", "", 90, "z"), (51, None, "", 90, "z"), (52, "nobody", "", 90, "z"), (53, "qf", FR, 90, "z"), (54, "qf", PROSE, 90, "z")]
    results += [(i, f"q{i}", f"{PROSE} Case {i} was kept.", 90, "z") for i in range(10, 45)]
    inter = [(i, x, (f"q{i}", "A"), "z") for i, x in cases.items() if i < 4] + [(20, PROSE, (None, None), "z"), (21, PROSE, None, "z")]
    return (
        spark.createDataFrame(results, "result_id long, request_id string, text string, generated_tokens int, prompt string"),
        spark.createDataFrame(inter, "interpretation_id long, text string, metadata struct<request_id:string,source_paper_dataset:string>, pair_id string"),
        spark.createDataFrame(prompts, "request_id string, prompt string, max_tokens int, text string"),
    )


def test_defects(spark):
    got = {(r["origin"], r["pair_id"]): r["defect"] for r in p2_pairs.severest(p2_pairs.defects(*pairs_tables(spark))).collect()}
    want = {("result", 1): "empty", ("result", 2): "refusal", ("result", 3): "copied_prompt", ("result", 4): "other_language", ("result", 5): "truncated", ("result", 6): "empty", ("result", 7): "refusal", ("result", 9): "refusal", ("result", 54): "other_language"}
    want |= {("interpretation", 1): "empty", ("interpretation", 2): "refusal", ("interpretation", 3): "copied_prompt"}
    assert {k: v for k, v in got.items() if k in want} == want
    assert not {k for k in got if k not in want}
    both = [(i, f"q{i}", "I'm sorry, but I can't help with this request: the sensor and the pars", 500, "z") for i in range(45, 50)]
    tables = pairs_tables(spark)
    labels = {(r["pair_id"], r["defect"]) for r in p2_pairs.defects(tables[0].union(spark.createDataFrame(both, tables[0].schema)), *tables[1:]).collect()}
    assert {(45, "refusal"), (45, "truncated")} <= labels  # several labels of one answer
    empty = [x.limit(0) for x in pairs_tables(spark)]
    assert p2_pairs.defects(*empty).count() == 0


def test_long_refusals_are_read_whole():
    text = "This paper was sent to us with a long list of questions about the way in which the sensor and the parser are used in the field. After some thought about what is asked here, I cannot answer this question. " + "The figure is about the sensor and the parser and it was drawn by the authors of the paper in the year of the study."
    assert p2_pairs.refusal_votes(text)[2] == 1 and p2_pairs.refusal_votes(PROSE)[2] == 0


@pytest.mark.parametrize("prompt, text, wrong", [("Answer in Italian: what does the figure show?", "La figura mostra che la misura del sensore è stata ripetuta nelle prove e che il valore non è più alto della media.", False), ("Descrivi come il sensore è presentato in questo articolo e quali sono le misure.", "La figura mostra che la misura del sensore è stata ripetuta nelle prove e che il valore non è più alto della media.", False), ("Answer in Portuguese: what does the figure show?", "A figura mostra que a medição do sensor não foi repetida nos ensaios e que o valor é mais alto do que a média.", False), ("Answer in Portuguese: what does the figure show?", FR_TEXT, True), ("Answer in English.", FR_TEXT, True)])
def test_language_votes(prompt, text, wrong):
    assert (sum(p2_pairs.language_votes(language.expected(prompt), text, p2_pairs.words_of(text))) > 0) == wrong


def test_functions_do_not_vote_in_unison(spark):
    """No two functions of a defect are one: each pair of them disagrees, or one is silent, on some of the answers."""
    closes = np.zeros(closing.SLOTS)
    texts = [None, "", "[]", "null", "Yes.", "No", PROSE, PROSE[:-20], "I'm sorry, I can't help.", "Leider nicht.", PROMPT, PROMPT.upper(), FR_TEXT, '[{"cue": "a', '{"cues": [], "note": "I cannot access the figure."}', PROMPT.split("\n")[0] + " " + PROSE, "We cannot exclude it. I refuse to answer.", "...", " ".join(reversed(PROMPT.split())), PROMPT.split("\n")[0] + " It is presented in this paper as neutral.", "Describe how this paper is presented."]
    for defect, k in p2_pairs.FUNCTIONS.items():
        columns = list(zip(*(p2_pairs.votes_of(PROMPT, x, 90, 80, (closes, closes), 0.25)[defect] for x in texts)))
        assert len(columns) == k == len(set(columns)), defect


def test_labelled_sample_has_every_defect():
    pairs = [(PROMPT, PROSE), ("Résumez le passage qui porte sur la mesure du champ.", FR_TEXT)] * 10
    rows = p2_pairs.labelled(pairs)
    assert {x[3] for x in rows} == {"", *p2_pairs.DEFECTS} and sum(not x[3] for x in rows) == 20


@pytest.mark.parametrize("text, yes", [("Thank you for the question, but it is not possible for me to fulfil this.", True), ("Je suis désolé, mais il m'est impossible de décrire la dégradation.", True), ("I'm sorry that I cannot recall the title, but it compared a sensor with a parser.", False), ("We cannot exclude that the sensor affects the parser, and the authors decline to give a sen", False), ("The corpus contains turns such as “I'm sorry, I can't help with that”, which are tagged.", False), ("My guidelines keep me from answering.", True)])
def test_refusal_votes(text, yes):
    assert (sum(p2_pairs.refusal_votes(text)) > 0) == yes
