import random

import numpy as np
import pytest

from foliomill.llm import p5_scans, p6_encode, p8_residue, scan_lines, tokenizer

WORDS = "the remaining error is explained by clinical sensor rather than neural parser we compare porous assay with a hybrid vaccine in field plots each time-resolved genome was reviewed and recorded under pressure".split()


@pytest.fixture(scope="module")
def model():
    counts = {w: 500 for w in WORDS}
    return scan_lines.Model(counts, 20_000, {}, np.zeros((0, 1)), np.zeros((0, 1)), frozenset())


def noise(text, model):
    return scan_lines.read(text, model)


def test_repair(model):
    text = "\n".join(["Hybrid vaccine", "the remaining err0r is explained by the clin-", "ical sensor rather than by the time-", "— 12 —", "resolved parser. We compare the p~orous", "Hybrid vaccine", "assay with a vaccíne in field", "", "plots.", "- 13 -"])
    found, fixed = noise(text, model)
    assert (2, "hyphen_break") in found and (3, "hyphen_break") not in found
    assert {(1, "running_header"), (6, "running_header"), (4, "page_number"), (10, "page_number"), (2, "misread"), (5, "misread"), (7, "misread")} <= set(found)
    assert "remaining error is explained by the clinical sensor rather than by the time-resolved parser. We compare the porous assay" in fixed
    assert "Hybrid vaccine" not in fixed and "12" not in fixed


def test_clean_text_stays(model):
    text = "# Methods\n\nThe CO2 level and the N400 effect were logged in 3D by the B12 unit. Samples A1-A9 were kept.\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n203\n77.5\n897\n\n1. use of a clinical sensor\n\nProof."
    assert noise(text, model)[0] == []
    assert noise("", model) == ([], "")


@pytest.mark.parametrize("line, number", [("12", 12), ("- 12 -", 12), ("[7]", 7), ("Page 3", 3), ("p. 44", 44), ("1 2 1", 121), ("l84", 184), ("xcvii", -1), ("117 / 137", 117)])
def test_page_numbers(line, number):
    assert scan_lines.page_number(line) == number


@pytest.mark.parametrize("line", ["1987.", "34 %.", "118.5", "[3].", "mild", "civil", "et al., 2008).", "a 12 b"])
def test_no_page_numbers(line):
    assert scan_lines.page_number(line) is None


def test_skip_gram_learns_company():
    rng = random.Random(0)
    a, b = list(range(0, 6)), list(range(6, 12))
    texts = [np.array([rng.choice(side) for _ in range(12)]) for side in (a, b) for _ in range(300)]
    inner, outer = (np.random.default_rng(1).random((12, p5_scans.DIMENSIONS)).astype(np.float32) - 0.5) / 24, np.zeros((12, p5_scans.DIMENSIONS), np.float32)
    for r in range(12):
        inner, outer, seen = p5_scans.train_partition(texts, inner, outer, np.ones(12), r)
    fit = inner @ outer.T
    assert seen.min() > 0 and fit[:6, :6].mean() > fit[:6, 6:].mean() + 0.5


def test_context_decides_a_misreading():
    """Of two words a glyph apart, a rarer one stands where it belongs, and is mended where the other does; without vectors neither is told."""
    counts = {"modern": 900, "modem": 60, "art": 500, "house": 500, "cable": 500, "signal": 500}
    ids = {w: k for k, w in enumerate(sorted(counts))}
    inner, outer = np.zeros((len(ids), 2), np.float32), np.zeros((len(ids), 2), np.float32)
    for w, v in {"modern": (1, 0), "art": (1, 0), "house": (1, 0), "modem": (0, 1), "cable": (0, 1), "signal": (0, 1)}.items():
        inner[ids[w]] = outer[ids[w]] = v
    model = scan_lines.Model(counts, 10_000_000, ids, inner, outer, frozenset())
    assert model.correction("modem", ["art", "house"]) == "modern" and model.correction("modem", ["cable", "signal"]) is None
    flat = scan_lines.Model(counts, 10_000_000, ids, inner * 0, outer * 0, frozenset())
    assert flat.correction("modem", ["art", "house"]) == flat.correction("modem", ["cable", "signal"])
    assert model.correction("modcrn", ["art", "house"]) == "modern" == flat.correction("modcrn", [])


def test_storage_does_not_show(spark):
    """The same vectors, rows and texts however the table is cut into partitions."""
    rng = random.Random(5)
    body = lambda: " ".join(rng.choice(WORDS) for _ in range(60)) + "."
    rows = [(i, body().replace("error", "err0r", 1)) for i in range(80)]
    df = spark.createDataFrame(rows, "sample_id long, markdown string")
    one, two = ({tuple(map(str, r)) for r in p5_scans.repaired(df.repartition(n)).collect()} for n in (2, 12))
    assert one == two and len(one) == 80


def test_pair_counts():
    codes, counts = p5_scans.count_pairs([np.array([0, 1, -1, 2])], 3)
    assert dict(zip(codes.tolist(), counts.tolist())) == {1: 1, 3: 1, 2: 1, 6: 1, 5: 1, 7: 1}


def test_repaired(spark):
    rng = random.Random(4)
    body = lambda: " ".join(rng.choice(WORDS) for _ in range(120)) + "."
    rows = [(i, body(), "x") for i in range(60)] + [(100, None, "x"), (101, "", "x"), (102, "the remaining err0r is explained", "x"), (102, "the remaining err0r is explained", "x"), (None, "a", "x")]
    df = spark.createDataFrame(rows, "sample_id long, markdown string, text string")
    got = {r["sample_id"]: r for r in p5_scans.repaired(df).collect()}
    assert len(got) == 63 and got[100]["text"] == "" and got[100]["noise"] == []
    assert [(n["line_no"], n["noise"]) for n in got[102]["noise"]] == [(1, "misread")] and "error" in got[102]["text"]
    assert p5_scans.repaired(df.limit(0)).count() == 0


TEXTS = ["", None, "Hello world", "it's  l'été \n\n\t naïve", "a" * 500, "ab" * 300, " " * 50 + "x", "日本語の測定 👩‍🔬", "<|endoftext|>", "́́", "0000000012345678901234567890", "x\r\ny z"]


def test_encoding_equals_the_public_library():
    encode = tokenizer.encoder()
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("abcdefghijklmnop qrstuvwxyz.,'") for _ in range(rng.randrange(200))) for _ in range(200)]
    got = p6_encode.encode_texts(texts, {}, tokenizer.BYTE_BPE_50K)
    assert got == [encode(x) if x else [] for x in texts]


def test_long_words_cost_their_length(tmp_path, monkeypatch):
    """Letters without a blank, one letter over and over, and tokens longer than a piece: as the public library has them, and no file is written."""
    monkeypatch.chdir(tmp_path)
    encode = tokenizer.encoder()
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000)), "".join(rng.choice("acgt") for _ in range(9_000)), "a" * 20_001, "=" * 5_555, ("a" * 37 + "b") * 300, "測定値" * 2_000, " " * 3_000 + "x"]
    assert p6_encode.encode_texts(texts, {}, tokenizer.BYTE_BPE_50K) == [encode(x) for x in texts]
    assert not list(tmp_path.iterdir())


def test_encoded(spark):
    df = spark.createDataFrame([(i, x, "z") for i, x in enumerate(TEXTS)] + [(2, "Hello world", "z"), (None, "x", "z"), (2**62 + 1, "x", "z")], "doc_id long, text string, ids string")
    rows = p6_encode.encoded(df).collect()
    assert len(rows) == len(TEXTS) + 3 and {None, 2**62 + 1} <= {r["doc_id"] for r in rows}
    rows = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 100]
    back = {v: k for k, v in tokenizer.ranks().items()}
    for r in rows:
        assert b"".join(back[i] for i in r["ids"]).decode() == (TEXTS[r["doc_id"]] or "")
    assert p6_encode.encoded(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["# {{ title }}\n\nWe compare two sensors.", "The ${venue} was chosen.", "By [[author_list]]", "%(doi)s", "__SECTION_BODY__", "<Author List>", "«title»", "#{first_author}", "[INSERT ABSTRACT]", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Ipsum lorem magna elit dolor sit labore aliqua veniam.", "404 Not Found", "Oops! Something went wrong. Please try again later.", "Bitte aktivieren Sie JavaScript, um diesen Artikel zu lesen.", "Accès refusé.", "xxxx xxxx xxxx xxxx xxxx", "Your text starts here.", "A sound text.\n\nTODO: write the conclusion\n\nMore text."])
def test_residue(text):
    index = p8_residue.Index({"": 1000, "the": 900, "a": 800, "of": 700, "not": 300, "to": 600})
    assert p8_residue.residue(text, index)[0] >= 1


@pytest.mark.parametrize("text", ["Of the crawled links, 31 returned 404 Not Found and 12 a 502 Bad Gateway.", "Slots such as {{name}} or ${user} are filled in at build time by the template engine under study.", "We write $${{a}_{i}}^{2}$$ for the squared weight and {x_i} for the set.", "The class defines __init__ and __call__; the log line is printed with %d and %s.", "In the reading task, lorem ipsum passages served as a control without meaning.", "The motif CXXXXC and the allele [INS 12bp] were retained.", "Participants saw <i>target</i> words in <b>bold</b> face.", "Erratum: the value in Table 2 should read 789.", "Il parle de «mesure» et de «stabilité».", "The survey page asked readers to enable JavaScript, which 4 % had disabled."])
def test_no_residue(text):
    index = p8_residue.Index({"": 1000, "the": 900, "a": 800, "of": 700, "not": 300, "to": 600})
    assert p8_residue.residue(text, index)[0] < 1


#: Residue in wordings that no exemplar has.
HELD_OUT = """The page that you have requested was not found|Sorry, the page you are looking for could not be found on this server|HTTP 404 – Page Not Found|Error 403: Forbidden|500 – Internal Server Error occurred|502 Bad Gateway nginx|503 Service Temporarily Unavailable|504 Gateway Time-out: Gateway Timeout|Something went wrong. Try again later.|An unexpected error occurred. Please try again.|Access to this page has been denied|You don't have permission to access this document|Your session has timed out. Your session expired.|Please sign in again to view this document|The document you requested could not be loaded|This content is no longer available here
Please enable JavaScript in your browser to view this page|JavaScript must be enabled to view this site|Your browser does not support JavaScript or scripts are disabled|This page requires JavaScript to be enabled|You need to enable JavaScript and cookies to continue|This website uses cookies to improve your experience|Please enable cookies to continue reading|Enable JavaScript to view this article
Insert your text here|Insert figure here|Type your abstract here|Enter the title of your paper here|Click here to enter your abstract|Your abstract goes here|Replace this text with your own paragraph|Your introduction here|Add your references here|TODO: write this section|TODO: insert references here|To be completed before submission by the authors
Lorem ipsum dolor sit amet consectetur|Dolor sit amet elit tempor magna aliqua|This is placeholder text for the layout|This dummy text shows the layout only|la la la la la la|qwerty qwerty qwerty qwerty
La page demandée n'existe pas|Page introuvable (erreur 404)|Accès refusé à ce document|Veuillez activer JavaScript pour lire cet article|Une erreur interne est survenue|Insérez votre texte ici|Seite wurde nicht gefunden (404)|Aktivieren Sie bitte JavaScript, um die Seite zu lesen|Interner Fehler: Es ist ein Fehler aufgetreten|Hier Ihren Text einfügen|La página no se ha encontrado|Active JavaScript para ver esta página|Se ha producido un error interno del servidor|Inserte aquí su texto|Hello ${first_name}|Published in [[journal]]"""
#: Texts about such things, and the like of them.
SOUND = """Of 300 requests, 12 ended with a 404 Not Found error and were sent again|We removed all pages that returned an internal server error from the corpus|Half of the participants clicked on the cookie banner before they read the article|The lorem ipsum condition served as a baseline for reading speed|Users who had disabled JavaScript could not take part in the survey|The parser replaces each placeholder token before training begins|The engine fills slots such as {{author}} in a template when it renders the page|The study was repeated because two sessions expired before the interview ended|The gateway and the server exchange messages over a secure channel|The error of the estimate is given in the title of each figure|The authors thank the editors and the reviewers of the journal|The service was unavailable to rural patients during the winter|The method could not be found in the earlier literature|An unexpected result occurred in the second experiment|Access to clean water was denied to many villages|The text of the abstract was written by the first author"""


def test_held_out_residue():
    """Of wordings that no exemplar has, 90 % are found, and texts about such things are let be."""
    index = p8_residue.Index({"": 1000, "the": 900, "a": 800, "of": 700, "not": 300, "to": 600, "in": 700, "and": 800, "was": 500, "is": 500, "for": 500, "be": 300, "this": 300, "you": 20, "your": 10, "here": 10, "page": 30, "text": 40, "error": 60, "by": 400, "that": 400, "with": 500, "authors": 60, "title": 20})
    cases = HELD_OUT.replace("\n", "|").split("|")
    assert set(cases).isdisjoint(x for text in p8_residue.EXEMPLARS.values() for x in text.strip().replace("\n", "|").split("|"))
    lost = [x for x in cases if p8_residue.residue(f"We compare two sensors in field plots.\n\n{x}\n\nEach genome was reviewed.", index)[0] < 1]
    assert len(lost) <= 0.1 * len(cases), lost
    assert not [x for x in SOUND.split("|") if p8_residue.residue(f"We compare two sensors. {x}.", index)[0] >= 1]


def test_key_tokens_lose_nothing():
    """The index with a few key tokens an exemplar gives what every exemplar gives."""
    rng = random.Random(9)
    index = p8_residue.Index({"": 1000, "the": 900, "page": 50})
    words = sorted(p8_residue.VOCABULARY)
    for _ in range(500):
        x = rng.choice(index.all)
        window = [t for t in sorted(x.tokens) if rng.random() < 0.85] + rng.sample(words, 2)
        keep = index.postings
        fast = index.match(window)
        index.postings = {t: [k for k, y in enumerate(index.all) if t in y.tokens] for t in words}
        assert fast == index.match(window) or fast[0] < 1 and index.match(window)[0] < 1 or "mention" in (fast[1], index.match(window)[1]) and fast[0] == 0.0
        index.postings = keep


def test_judged(spark):
    plain = "We compare the porous assay with a hybrid vaccine in field plots. Each genome was reviewed by two readers."
    rows = [(i, plain, "x") for i in range(40)] + [(50, None, "x"), (51, "", "x"), (52, " \n", "x"), (53, plain + "\n\nPlease enable JavaScript to view this article.", "x"), (53, plain + "\n\nPlease enable JavaScript to view this article.", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = p8_residue.judged(df).collect()
    assert len(got) == 45 and {r["doc_id"] for r in got if r["score"] >= 1} == {53}
    assert p8_residue.judged(df.limit(0)).count() == 0
