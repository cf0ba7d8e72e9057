from __future__ import annotations

import sys
import time
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from heldout import CLEAN as SAID
from heldout import FILLER as HELD_FILLER
from heldout import NOTICES as HELD_NOTICES
from heldout import PAGES as HELD_PAGES
from heldout import SLOTS as HELD_SLOTS
from quillon.llm.residue import is_filler, mark_residue, residue_of, without_residue

SLOTS = [
    "Dear {{ first_name }},", "Hello {{{user}}} team, thanks for writing.", "Your order {{order.id | default}} is on its way.", "Hi [[name]]!", "Kind regards, %AGENT%", "See %%topic%% for more.",
    "Your reference is *|TICKET|*.", "Hello <%= customer %>,", "Thanks for asking about ${product}.", "We moved #{company} to a new plan.", "In {%version%} this is no longer needed.", "Title: ______", "Hello XXXXX team,",
    "Dear @@USER@@,", "Dear __FIRST_NAME__,", "Your plan is [INSERT PLAN].", "Bonjour <VOTRE NOM ICI>,", "Hallo [hier Namen eintragen],", "Olá (SEU NOME AQUI),", "Cordialement, «prenom»", "Hello %1$s,", "Hello {0},", "Hi &#123;&#123;user&#125;&#125;,",
    "Hi \\{\\{user\\}\\},", "Hi ｛｛user｝｝,", "Dear (TBD: company),", "Hello %(name)s,", "A long answer that explains the option.\n\nBest wishes from {{agent}}",
]
FILLER = ["Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "blah blah blah blah", "test test test 123", "Replace this paragraph with your own answer.", "asdf asdf asdf", "Dies ist ein Blindtext für das Layout.", "Texte à remplacer.", "xxx xxx xxx", "How do I sort?\n\nYour content goes here.", "L​orem ip​sum dolor amet sit"]
PAGES = ["404 Not Found", "Forbidden (403)", "HTTP Status 410: the resource is gone", "Forum | Access denied", "Seite nicht gefunden (404)", "Your session has expired. Sign in again to continue.", '{"status": 500, "error": "Server"}', "<Error><Code>403</Code><Message>No</Message></Error>", "How do I sort?\nService Unavailable\nPlease come back in a few minutes.", "ERROR  404 :  no  such  thread"]
NOTICES = ["Please enable JavaScript to view this page.", "Votre navigateur bloque les scripts.", "Esta aplicación necesita JavaScript.", "Site - Help - This application works only with scripts switched on. - Request id 1f2e3d4c", "Ativе o JavaScript para vеr esta página."]
CLEAN = [
    None, "", "  \n", "No.", "Use `{{ name }}` in the template.", "```\nHello {{ name }}\n```\nworks for me.", "    <p>{{ row }}</p>\n\nThat is the line.", "The letter went out with [INSERT NAME] still in it, because the field was null.",
    "The cell showed #{total} because the string was single-quoted.", "The set {{1, 2}, {3}} has two members.", "I used lorem ipsum in the mock-up and the index picked it up.", "How can I show \"Please enable JavaScript\" only once?",
    "The server answers 404 as soon as the key is empty.", "With JavaScript disabled the form still posts the file.", "As of 3.1 the export script is no longer needed.", "Access denied usually means that the job runs under another account.",
    "I followed [this guide](https://a.example/b).", "asdf is what I type when I test the form, too.", "[SOLVED] it was the cache", "What placeholder text do you show while it loads?", "Error 429 goes away when I set the limit to 5.", "Thanks!", "TODO comments in the parser are fine.",
]


@pytest.mark.parametrize("kind, texts", [("placeholder", SLOTS), ("filler", FILLER), ("error page", PAGES), ("script notice", NOTICES), (None, CLEAN)])
def test_kinds(kind, texts):
    assert {t: residue_of(t) for t in texts} == dict.fromkeys(texts, kind)


def test_table_with_nulls_copies_and_clashing_names(spark):
    rows = [(1, "404 Not Found", "a"), (1, "404 Not Found", "a"), (2, None, "b"), (3, "Fine.", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, residue string")
    out = mark_residue(df)
    assert out.columns == ["doc_id", "text", "residue", "residue_"]
    assert sorted((r["doc_id"], r["residue_"] or "") for r in out.collect()) == [(1, "error page"), (1, "error page"), (2, ""), (3, "")]
    kept = without_residue(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    assert mark_residue(df.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["a ", "{{ ", '"a ', "`x ", "((( ", "<a ", "Error ", "[x ", "\n    ", "«a ", "_", "X", "'a "])
def test_time_is_linear_in_the_length(unit):
    took = []
    for n in (20_000, 80_000):
        text = unit * (n // len(unit))
        began = time.perf_counter()
        residue_of(text)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_no_text_is_too_long_to_be_read():
    trace = "404 Not Found\nTraceback:\n" + "  at app.run (line 12)\n" * 400
    furniture = "Service Unavailable\n" + "Request id 1f2e3d4c\n" * 400
    distinct = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200))
    assert [residue_of(x) for x in (trace, furniture, distinct + " blah" * 3000, distinct)] == ["error page", "error page", "filler", None]


@pytest.mark.parametrize("text", ["asdf jkl qwer zxcv", "aaaa bbbb cccc dddd", "blah-blah-blah-blah", "It starts here. blah blah blah blah. It ends there.", "lorem lorem ipsum"])
def test_filler_of_any_make(text):
    assert is_filler(text) or "." in text
    assert residue_of(text) == "filler"


@pytest.mark.parametrize("unit", ["- ", "id ---", "! 4", "asdf ", "404\n", "at x (line 1)\n"])
def test_time_of_pages_is_linear_in_the_length(unit):
    took = []
    for n in (20_000, 80_000):
        text = "id " + unit * (n // len(unit)) + "x"
        began = time.perf_counter()
        residue_of(text)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_recall_and_precision_on_texts_kept_apart():
    held = [*HELD_PAGES, *HELD_NOTICES, *HELD_SLOTS, *HELD_FILLER]
    assert sum(residue_of(x) is not None for x in held) >= 0.9 * len(held)
    assert sum(residue_of(x) is not None for x in SAID) <= 0.08 * len(SAID)


def test_tutorials_on_templates_are_discounted_by_context_and_density():
    assert residue_of("In Jinja you write {{ name }} to print a variable and use {{ name|upper }} for capitals. The same holds for {{ city }}.") is None
    assert residue_of("Dear {{ name }}, your order {{ number }} has left {{ city }}.") == "placeholder"


def test_notices_and_repeats_of_any_length():
    notice = "Please enable JavaScript to view this page.\n"
    assert residue_of(notice * 3) == residue_of(notice * 500) == "script notice"
    assert residue_of(" ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)) + " blah" * 4000) == "filler"
