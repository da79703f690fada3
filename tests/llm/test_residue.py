import pytest

from exonloom.llm import residue
from exonloom.llm.residue_words import CLASSES, sentence_class
from tests.llm.residue_wordings import ORDINARY, RESIDUE

GIT = "commit 0123456789abcdef0123456789abcdef01234567\nAuthor: A B <a@b.example>\nDate:   2020-01-01 00:00:00 +0000\n\n    {}\n\ndiff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n+Lorem ipsum {{{{ title }}}}\n"
MAIL = "From: A B <a@b.example>\r\nDate: 2020-01-01\r\nSubject: [PATCH] {}\r\n\r\n---\r\n\r\ndiff --git a/x b/x\r\n"
CASES = {
    "{{ title }}": "placeholder",
    "[your scope here](TODO: add component): <subject>\n\n- __BODY__\n- XXX link XXX": "placeholder",
    "# Please fill the template\n## Context\n<component>\n## Change\nCHANGE GOES HERE": "placeholder",
    "feat: null\n\nundefined": "placeholder",
    "Fix the parser\n\n${WHY}\n\n«details»": "placeholder",
    "Lorem ipsum dolor sit amet consectetur adipiscing elit": "filler",
    "Fix the parser\n\nasdf asdf asdf asdf asdf asdf": "filler",
    "Hier steht später der Text.": "filler",
    "Your text here. Your text here. Your text here.": "filler",
    "x__-X.x_XX-x": "filler",
    "HTTP 503\n\nrequest id: 9f2a11": "error_page",
    "<html><head><title>404</title></head>\n<body><h1>Not Found</h1><p>Page introuvable.</p></body></html>": "error_page",
    '{"error": {"code": 502, "text": "Could not load this commit. Contact support.", "trace": "8e7f"}}': "error_page",
    "Fix the parser\n\nYour session has expired. Please sign in to continue.": "error_page",
    "THE  SITE  IS  OVERLOADED.  TRY  AGAIN  LATER.": "error_page",
    "Please enable JavaScript to view this page.": "scripts_required",
    "<noscript>Without JS the viewer stays blank.</noscript>\n\nid 12ab34": "scripts_required",
    "Veuillez activer JavaScript pour voir cette page.": "scripts_required",
    "Schalten Sie JavaScript ein, um die Seite anzuzeigen.": "scripts_required",
    "x": None,
    "tmp": None,
    "": None,
    "Merge branch 'wip/x' into main": None,
    'Revert "Lorem ipsum"\n\nThis reverts commit 0123456.': None,
    "Show a 404 page for deleted branches\n\nBefore, f answered with an empty body.": None,
    "Retry on 503 Service Unavailable from the cache backend": None,
    "Translate the 'Access denied' text of the login dialog": None,
    "Replace lorem ipsum in the fixture by generated words": None,
    "Drop dummy text from the demo\n\n'Text goes here' was visible to visitors for a while.": None,
    "Let x skip pages that say JavaScript is required": None,
    "Add noscript notice to the viewer\n\nVisitors with JavaScript disabled saw a blank panel.": None,
    "Escape {{ user.name }} in the mail template": None,
    "Document placeholder syntax such as %TITLE% and [VERSION]": None,
    "Reject commits that keep <type>(<scope>): <subject> as title": None,
    "chore(release): 1.2.3 [skip ci]": None,
    "[CORE-12] Stop printing undefined in f": None,
}


def test_verdicts_in_all_layouts(spark):
    data, want = [], {}
    for n, (m, reason) in enumerate(CASES.items()):
        for k, text in enumerate((m, GIT.format(m.replace("\n", "\n    ")), MAIL.format(m) if "\n" not in m else m + "\n\ndiff --git a/x b/x\n", "0123456789 A B 2020-01-01\n\n" + m + "\n\nSigned-off-by: A B <a@b.example>")):
            data.append((n * 4 + k, text, "clash"))
            if reason:
                want[n * 4 + k] = reason
    data += [(9000, None, ""), (9001, "  \n ", ""), (9002, "word " * 200_000, ""), (9003, "{" * 20_000, "")]
    want[9002] = "filler"  # one word over and over
    df = spark.createDataFrame(data, "doc_id long, text string, template string")
    text = {i: t for i, t, _ in data}
    got = {r.doc_id: r.reason for r in residue.verdicts(df).collect()}
    assert {k: (got.get(k), want.get(k), text[k][:90]) for k in set(got) | set(want) if got.get(k) != want.get(k)} == {}
    left = {r.doc_id for r in residue.clean_documents(df).collect()}
    assert left == {i for i, _, _ in data} - set(want)


def _verdict(message):
    """As verdicts() combines the sentences, each for itself."""
    seen = {sentence_class(x) for x in residue.sentences(residue.strip_headers(message.replace("\\n", "\n")))}
    if None in seen or "beside" in seen and not seen & {"scripts_required", "error_page"}:
        return None
    return next((c for c in CLASSES if c in seen), None)


def test_wordings_in_many_languages():
    cases, ordinary = (x.strip().split("\n") for x in (RESIDUE, ORDINARY))
    assert len(cases) > 150 and sum(_verdict(x) is not None for x in cases) >= 0.9 * len(cases)
    assert sum(_verdict(x) is not None for x in ordinary) <= 0.1 * len(ordinary)


def test_places_that_vary_are_mined(spark):
    """A word that nobody knows breaks a sentence, unless the tree met others in its place."""
    text = "The {} could not be loaded"
    one = spark.createDataFrame([(1, text.format("zorb"))], "doc_id long, text string")
    assert residue.verdicts(one).count() == 0
    many = spark.createDataFrame([(i, text.format(x)) for i, x in enumerate(("zorb", "plim", "quast", "zorb"))], "doc_id long, text string")
    assert {r.doc_id for r in residue.verdicts(many).collect()} == {0, 1, 2, 3}
    assert {r.template for r in residue.mine_templates(many.selectExpr("lower(text) as sentence", "1L as n")).collect()} == {"the <*> could not be loaded"}


def test_leaves_merge_only_similar_sentences():
    leaf = [x.split(" ") for x in ("the page abc could not load", "the page bcd could not load", "the page cde could not load", "the page abc is not here")]
    assert residue.merge_leaf(leaf) == ["the page <*> could not load"] * 3 + ["the page abc is not here"]


def test_hot_leaves_are_mined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(residue, "LEAF_ROWS", 10)
    df = spark.createDataFrame([(f"the zq{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]} could not be loaded", 1) for i in range(100)], "sentence string, n long")
    got = residue.mine_templates(df).collect()
    assert len(got) == 100 and {r.template for r in got} == {"the <*> could not be loaded"}


def test_the_body_under_an_automatic_subject_is_judged(spark):
    df = spark.createDataFrame([(1, "Merge branch 'a' into b\n\nLorem ipsum dolor sit amet consectetur"), (2, "Merge branch 'lorem ipsum' into b"), (3, "Autosize the pool\n\nLorem ipsum dolor sit amet")], "doc_id long, text string")
    assert {(r.doc_id, r.in_unit) for r in residue.verdicts(df).collect()} == {(1, "body"), (3, "body")}


def test_open_slots(spark):
    df = spark.createDataFrame([(1, "Escape {{ user.name }} and ${X} in mails\n\ndiff --git a/x b/x\n+{{ y }}\n"), (2, "{{ title }}"), (3, "plain words"), (4, None)], "doc_id long, text string")
    assert [tuple(r) for r in residue.open_slots(df).collect()] == [(1, 2, 1)]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert residue.verdicts(df).count() == 0 and residue.open_slots(df).count() == 0


@pytest.mark.parametrize("text", ["", "a", "|", "((((", "[" * 3000, "<" * 3000 + ">" * 3000, "\u3042" * 5000])
def test_masking_is_robust(text):
    [sentence_class(x) for x in residue.sentences(text.split("\n"))]
