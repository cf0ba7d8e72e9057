"""Template residue and error-page text: records in which a machine's text stands in place of the author's words.

Method: a text is normalised (compatibility forms, invisible characters, look-alike letters, entities), and what the author shows
rather than says is taken out: fenced, indented and marked-up code, inline code, quotations. In what remains, unfilled
placeholders are found by one grammar per delimiter notation; filler by vocabulary density and repetition; pages of servers and
sites, and notices about scripts, by sentence patterns that have to make up the whole rest of a text, not occur in it.
Surrounding context discounts placeholders that are talked about: words of showing and of template languages right before or
after them, and names that the shown code uses more often. A text in which most placeholders are talked about is a tutorial, and
none of its placeholders counts (density).

The scan is one pass of an Arrow function; no row is shuffled or collected. A filter in the JVM only spares Python the texts
without a letter or sign that residue could be made of, since the signs of placeholders and the words of pages stand in most
posts about software.

Defined results for edge cases: null and blank texts are clean; a text is classified whole, whatever its length (all patterns are
linear: they are anchored or bounded); repeated rows are classified each by itself; other columns are carried along; the added
column is called ``residue`` or the first free name with an underscore appended; an empty table gives an empty one.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:  # the same answers, one sign after the other
    ahocorasick = None


def finder(signs: Iterable[str]) -> Callable[[str], bool]:
    """A function that says whether a text holds one of the signs, in one pass over the text."""
    signs = tuple(signs)
    if ahocorasick is None:
        return lambda text: any(sign in text for sign in signs)
    automaton = ahocorasick.Automaton()
    for sign in signs:
        automaton.add_word(sign, 1)
    automaton.make_automaton()
    return lambda text: next(automaton.iter(text), None) is not None


# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіјѕԁԛԝАВЕКМНОРСТХУІЈЅαοιρνΑΒΕΗΙΚΜΝΟΡΤΥΧΖ", "aeopcyxijsdqwABEKMHOPCTXYIJSaoipvABEHIKMNOPTYXZ")
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u206a-\u206f\ufe00-\ufe0f\ufeff]")

_MIXED = re.compile("[A-Za-z]+[\u0370-\u03ff\u0400-\u04ff][A-Za-z\u0370-\u03ff\u0400-\u04ff]*|[\u0370-\u03ff\u0400-\u04ff]+[A-Za-z][A-Za-z\u0370-\u03ff\u0400-\u04ff]*")


def normalise(text: str) -> str:
    """Compatibility forms, no invisible characters, Latin letters for look-alikes, entities and escapes resolved."""
    text = html.unescape(html.unescape(text)) if "&" in text else text
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
        if not text.isascii():
            text = _MIXED.sub(lambda m: m[0].translate(LOOKALIKES), text)
    return re.sub(r"\\([{}\[\]<>$%#@_*|])", r"\1", text) if "\\" in text else text


_FENCE = re.compile(r"(?ms)^[ ]{0,3}(```+|~~~+)[^\n]*\n.*?(?:^[ ]{0,3}\1[^\n]*$|\Z)")
_MARKED = re.compile(r"(?is)<(pre|code|kbd|samp|script|style|blockquote)\b[^>]*>.*?(?:</\1\s*>|\Z)")
_INDENTED = re.compile(r"(?m)^(?: {4}|\t)[^\n]*$")
_INLINE = re.compile(r"(`+)(?!`)[^\n]*?(?<!`)\1(?!`)")
_QUOTED_LINE = re.compile(r"(?m)^[ ]{0,3}>[^\n]*$")
_QUOTED = re.compile(r"\"[^\"\n]{1,300}\"|“[^”\n]{1,300}”|„[^“”\n]{1,300}[“”]|«[ \u00a0\u202f][^»\n]{1,300}»|(?<![\w])'[^'\n]{2,300}'(?!\w)")
_QUOTES = re.compile("[\"\u201c\u201e\u00ab']")
_BLANKS = re.compile(r" {2,}")
_STOP_APART = re.compile(r" [.,:;!?)]")
_BEFORE_STOP = re.compile(r" ([.,:;!?)])")
CODE = "\u241f"


def own_words(text: str) -> str:
    """The text without what is shown as code or quoted; each such part leaves a mark."""
    if "```" in text or "~~~" in text:
        text = _FENCE.sub(CODE, text)
    if "<" in text:
        text = _MARKED.sub(CODE, text)
    if "    " in text or "\t" in text:
        text = _INDENTED.sub(CODE, text)
    if ">" in text:
        text = _QUOTED_LINE.sub(CODE, text)
    if "`" in text:
        text = _INLINE.sub(CODE, text)
    if _QUOTES.search(text):
        text = _QUOTED.sub(CODE, text)
    text = _BLANKS.sub(" ", text) if "  " in text else text
    return _BEFORE_STOP.sub(r"\1", text) if _STOP_APART.search(text) else text


# ---------------------------------------------------------------------------------------------------------------------------
# Unfilled placeholders: one grammar per delimiter notation, over the author's own words.

_NAME = r"[A-Za-zÀ-ÿ_][\wÀ-ÿ]*(?:\.[\wÀ-ÿ]+)*"
_WORDS = r"[A-ZÀ-Þ][A-ZÀ-Þ_]*(?:[ _-][A-ZÀ-Þ]+){0,4}"
# How templates ask for a value in words (insert ..., your ... here), by language.
_ASK_FIRST = r"(?:insert|add|enter|fill in|type|put|your|insérer|insérez|ajouter|votre|insertar|inserte|añadir|su|tu|inserir|insira|adicionar|seu|sua|einfügen|eintragen|bitte|hier|ihr|ihre|name of)"
_ASK_LAST = r"(?:here|goes here|hier|ici|aquí|aqui|einfügen|eintragen|einsetzen|tbd|to be filled)"
_ASKED = rf"(?:{_ASK_FIRST}\b[^<>\[\](){{}}\n]{{1,40}}|[^<>\[\](){{}}\n]{{1,40}}\b{_ASK_LAST})"
# What templates leave open most often, by language, as the last or first word in brackets.
_NOUN = (
    r"(?:name|first ?name|last ?name|surname|date|time|address|company|position|title|number|amount|price|city|country|location|product|e-?mail(?: address)?|phone|website|url|link|signature|department|role|topic|subject"
    r"|name|vorname|nachname|firma|datum|adresse|ort|betrag|produkt|nom|prénom|entreprise|adresse|ville|montant|produit|nombre|apellido|empresa|fecha|dirección|ciudad|producto|nome|sobrenome|cognome|data|endereço|indirizzo|cidade|produto|prodotto)"
)
_WANTED = rf"(?:{_NOUN}|(?:[^\W\d_]+ ){{1,3}}{_NOUN}|{_NOUN} (?:of|des|der|du|de la|del|de|do|da) (?:[^\W\d_]+ ?){{1,3}})"
# Single words that stand in angle brackets for a value.
_BARE = r"(?:DATE|TIME|NAME|COMPANY|ADDRESS|AMOUNT|PRICE|CITY|LOCATION|PRODUCT|EMAIL|PHONE|NUMBER|VERSION|USER|CUSTOMER|TOPIC|SUBJECT|DATUM|FIRMA|NOM|FECHA|NOMBRE|NOME|DATA)"
GRAMMARS = {
    "double braces": rf"\{{{{2,3}}\s*[#/^&>]?\s*(?P<a>{_NAME})(?:\s*\|[^{{}}\n]{{1,40}})?\s*\}}{{2,3}}",
    "brace and percent": rf"\{{%-?\s*(?P<b>{_NAME})\s*-?%\}}",
    "angle and percent": rf"<%[=-]?\s*(?P<c>{_NAME})\s*-?%>",
    "dollar or hash brace": rf"(?<![$\\])[$#@]\{{\s*(?P<d>{_NAME})(?:\s*[|:][^{{}}\n]{{0,30}})?\s*\}}",
    "brace and sign": rf"\{{[$!]\s*(?P<q>{_NAME})\s*\}}",
    "single brace": rf"(?<![\w$#@{{=(,:])\{{!?\s*(?P<e>{_NAME}|\d{{1,2}})\s*\}}(?!\}}|\w)",
    "double brackets": rf"\[\[\s*(?P<f>{_NAME})\s*\]\]",
    "one at sign": r"(?<![\w@.])@(?P<r>[A-Z][a-z]+(?:[A-Z][a-z]+)+|[A-Z][A-Z_]{2,})@(?![\w@])",
    "percent": rf"(?<![\w%])%%(?P<g>{_NAME})%%(?!\w)|(?<![\w%])%(?P<h>[A-Z][A-Z_]+)%(?!\w)",
    "positional": rf"(?<![\w%])%(?:\d\$|\((?P<p>{_NAME})\))[sd]\b",
    "underscores": r"(?<![\w_])__(?P<i>[A-Z][A-Z0-9_]*?)__(?![\w_])|(?<![\w_])_{4,}(?![\w_])",
    "at signs": rf"(?<!\w)@@(?P<j>{_NAME})@@",
    "dollars": r"(?<![\w$])\$(?P<k>[A-Z][A-Z_]+)\$(?![\w$])",
    "star and bar": rf"\*\|\s*(?P<l>{_NAME})\s*\|\*",
    "guillemets": rf"«(?P<m>{_NAME})»",
    "crosses": r"(?<![\w-])[Xx]{5,}(?![\w-])|(?<![\w-])X{4}(?![\w-])|[$€£]X{1,3}(?:[,.]X{2,3})+(?!\w)",
    "brackets": rf"(?<![\w\]])\[(?!\])(?:(?P<n>{_WORDS})|(?i:{_ASKED}|{_WANTED}))\](?![(\[]|:\s*(?:https?:|[</#]))",
    "angles": rf"(?<!\w)<(?P<o>[A-Z][A-Z]+(?:[ _][A-Z]+)+)>|(?<!\w)<(?P<s>{_BARE})>|(?<!\w)<(?i:{_ASKED})>",
    "note to oneself": r"(?m:^)(?:TODO|TBD|FIXME)\s*:\s*(?i:write|add|insert|fill|describe|explain|complete|finish|update)\b[^\n]{0,80}(?m:$)",
    "to be done": r"[(\[<{](?:TBD|TBC|TODO|FIXME|XXX)\b[:\s]?[^()\[\]<>{}\n]{0,30}[)\]>}](?![(\[])",
    "parentheses": rf"\((?=[A-ZÀ-Þ ]+\))(?i:{_ASKED})\)|\((?i:{_ASK_FIRST}\b[^()\n]{{1,30}} {_ASK_LAST}|[^()\n]{{1,30}} goes here)\)",
}
#: The signs first, so that most places in a text are left at once.
PLACEHOLDER = re.compile(r"(?=[\[{<%$#@*«(_XxTF€£])(?:" + "|".join(GRAMMARS.values()) + ")")
# Bracketed words that people write as tags of a post.
_TAGS = {"DEFAULT", "INDEX", "SECTION", "MAIN", "ALL", "NONE", "NULL", "TRUE", "FALSE", "EDIT", "UPDATE", "SOLVED", "CLOSED", "DUPLICATE", "SIC", "NOTE", "WARNING", "ERROR", "INFO", "DEBUG", "WARN", "OK", "FAIL", "FAILED", "PASS", "BUG", "RFC", "WIP", "FAQ", "OT", "OP", "UPDATED"}
# Words of a sentence that reports what was shown, before or after a placeholder.
_SHOWN = re.compile(
    r"\b(?:show(?:s|ed|n|ing)?|print(?:s|ed)?|display(?:s|ed)?|render(?:s|ed)?|contain(?:s|ed)?|appear(?:s|ed)?|went out|came out|comes out|literal(?:ly)?|verbatim|unreplaced|unescaped"
    r"|single-quoted|still in it|interpolat\w*|steht|stand|gedruckt|zeigt\w*|angezeigt|affich\w+|imprim\w+|muestra|mostró|mostra|mostrou|aparec\w+|apparaî\w+|erscheint)\b",
    re.I,
)
# What stands right before or after a placeholder that a text is about.
_ABOUT_BEFORE = re.compile(
    r"(?:\b(?:write|writes|wrote|type|types|use|uses|using|used|evaluates?|expands?|escapes?|replaces?|substitutes?|denotes?|called|named|as in|such as|like|e\.g\.|syntax|notation|placeholders?|variables?|expressions?|tokens?|tags?|macros?|braces|brackets|schreib\w*|verwend\w*|benutz\w*|ersetzt|platzhalter|écri\w+|utilis\w+|remplac\w+|escrib\w+|usa\w*|reemplaza\w*|substitui\w*)"
    r"(?:\W+(?:the|a|an|every|each|any|all|of|by|with|den|die|das|jede[ns]?|le|la|les|chaque|el|los|cada|o|os))*\W*)$",
    re.I,
)
_ABOUT_AFTER = re.compile(
    r"^\W*(?:is|are|gets?|will be|was|were)?\s*(?:denotes?|means?|stands? for|evaluat\w+|expand\w*|expression|syntax|notation|placeholder|variable|tokens?|tag|macro|in (?:the|a|your) (?:template|string|format|url|path|config)|inside|between|to (?:print|output|get|escape|insert|access|refer)|replaced (?:by|with)|filled in|bedeutet|steht für|signifie|significa)\b",
    re.I,
)
# What every placeholder has one of.
_SIGNS = ("[", "{", "<", "%", "$", "@", "*|", "«", "€", "£", "__", "(", "xxxx", "XXXX", "Xxxx", "TODO", "TBD", "FIXME")
_may_be_open = finder(_SIGNS)
_STOP = re.compile(r"[.?!]\s|\n")


def _sentence(text: str, start: int, end: int) -> str:
    """The sentence around a place, looking 400 characters to either side."""
    left = max(0, start - 400)
    for stop in _STOP.finditer(text, left, start):
        left = stop.end()
    right = _STOP.search(text, end, end + 400)
    return text[left : right.start() if right else end + 400]


def open_slots(own: str, shown: str) -> list[str]:
    """Placeholders in the author's own words that are not talked about; ``shown`` is the text with its code."""
    if not _may_be_open(own):
        return []
    out, about, names = [], 0, {}
    for m in PLACEHOLDER.finditer(own):
        name = next((v for v in m.groupdict().values() if v), "")
        if name in _TAGS or (m[0][0] == "[" and len(name) == 1):
            continue
        start, end = m.span()
        if _ABOUT_BEFORE.search(own[max(0, start - 60) : start]) or _ABOUT_AFTER.search(own[end : end + 60]) or _SHOWN.search(_sentence(own, start, end)):
            about += 1
            continue
        # A name that the shown code uses as well is talked about, not left open.
        if len(name) > 3:
            if name not in names:
                names[name] = len(re.findall(rf"(?<!\w){re.escape(name)}(?!\w)", shown)) > own.count(name)
            if names[name]:
                continue
        out.append(m[0])
    return out if len(out) >= about else []


# ---------------------------------------------------------------------------------------------------------------------------
# Filler: vocabulary density, repetition, and sentences that stand in for a text to come.

# The words of the two passages of Cicero that typesetters have made mock Latin of, without their short ones.
MOCK_LATIN = frozenset(
    """lorem ipsum dolor amet consectetur consectetuer adipiscing adipisicing elit eiusmod tempor incididunt labore dolore magna aliqua enim minim
    veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum
    fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum perspiciatis unde omnis iste
    natus voluptatem accusantium doloremque laudantium totam aperiam eaque inventore veritatis quasi architecto beatae vitae dicta explicabo nemo
    ipsam voluptas aspernatur odit fugit consequuntur magni dolores ratione sequi nesciunt neque porro quisquam dolorem adipisci numquam""".split()
)
# Short words that a sentence of a living language hardly does without.
FUNCTION_WORDS = frozenset(
    """the a an and or of to in is it that this for with on as by at from be are was not i you he she we they my your if but so no
    der die das und oder von zu im ist es den dem ein eine mit auf für nicht ich sie wir wie wenn als aus bei
    le la les un une des du et ou de est il elle que qui dans pour avec sur pas je vous nous en au aux ce
    el los las una y o del al es por para con se su lo mi
    os um uma e do da dos das em no na com não eu seu sua ao
    che di il gli per non sono lo della""".split()
)
_LATIN_HARD = re.compile(r"(?:us|um|is|it|et|at|am|em|ae|ur|nt|ibus)$")
_LATIN = re.compile(r"(?:us|um|is|it|et|at|am|em|ae|ur|nt|a|o|e|i)$")
_WORD = re.compile(r"[^\W\d_]+")
# Sentences that announce a text instead of being one, by language: what each holds, one of it in a cheap look, and
# the sentence.
_ANNOUNCED = (
    ((" goes", " belongs", " comes", " here", " will go"), r"your (?:own )?(?:content|text|answer|description|title|message)s? (?:goes|belongs|comes|will go|here)"),
    ((" here", " in this ", " below"), r"(?:insert|add|type|enter|put|write|place|paste) (?:your |the |some )?(?:\w+ ){0,2}(?:text|content|body|copy|description|title|answer|post)\b[^.?!\n]{0,30}\b(?:here|in this (?:box|field|space)|below)"),
    (("replace",), r"(?:replace this (?:paragraph|text|sentence|line|block|section|content)|(?:will|to) be replaced)"),
    ((" be added", " be supplied", " be written", " be provided", " be filled in", " be inserted"), r"(?:description|text|content|details?|body|summary|answer)s? (?:to|will) be (?:added|supplied|written|provided|replaced|filled in|inserted)"),
    (("until the",), r"until the (?:real|final|proper) (?:ones?|text|words|content)"),
    (("publish",), r"(?:do not|don't|not to be) publish(?:ed)?"),
    (("headline", "heading"), r"(?:headline \d|sub-?heading)"),
    (("sample", "dummy", "filler", "placeholder"), r"(?:(?:sample|dummy|filler) text|placeholder (?:text|copy)|this is (?:a |only a |just a )?(?:placeholder|dummy|sample))"),
    (("coming", "follows"), r"(?:(?:text|content) (?:coming|follows) (?:soon|later)|coming soon)"),
    (("blindtext", "fülltext", "platzhalter", "mustertext"), r"(?:blindtext|fülltext|platzhalter(?:text)?|mustertext)"),
    (("hier ", " folgt", "wird noch"), r"(?:hier (?:steht|stehen|folgt|kommt) (?:später|bald|demnächst|noch|dann|ihr text|der text)|(?:text|inhalt|beschreibung) (?:folgt|wird noch|hier einfügen))"),
    (("texte ", "contenu", "description"), r"(?:texte (?:à (?:remplacer|venir|compléter|insérer)|de remplissage|d'exemple|fictif|provisoire)|(?:contenu|description) (?:à venir|à compléter|à remplacer)|votre (?:texte|contenu) ici)"),
    (("texto", "conteúdo", "contenido"), r"(?:texto (?:de (?:relleno|ejemplo|muestra|preenchimento|exemplo|prueba)|a (?:sustituir|reemplazar|substituir)|provisional|provisório|por sustituir)|(?:su|tu|seu) (?:texto|contenido|conteúdo) (?:aquí|aqui|va aquí|vai aqui))"),
    (("aquí ", "aqui "), r"(?:aquí (?:va|irá|vendrá) (?:el|su|tu)|aqui (?:vai|virá|entra) o)"),
    (("testo ", "tekst"), r"(?:testo (?:segnaposto|di (?:esempio|prova)|provvisorio)|plaatshoudertekst|voorbeeldtekst)"),
)
_ANNOUNCEMENTS = [(signs, re.compile(rf"\b{pattern}\b", re.I)) for signs, pattern in _ANNOUNCED]
_may_announce = finder(sign for signs, _ in _ANNOUNCED for sign in signs)


def _announces(segment: str) -> bool:
    low = segment.lower()
    return _may_announce(low) and any(pattern.search(segment) for signs, pattern in _ANNOUNCEMENTS if any(x in low for x in signs))


# Words of a person who talks about something, and of questions.
_TALK = re.compile(
    r"\b(?:I|I'm|I've|my|mine|me|how|what|why|which|usually|documented|still posts|as soon as|too|fine|ich|mein\w*|wie|warum|nehme|sobald|je|j'ai|mon|ma|mes|comment|pourquoi|dès que|yo|mi|cómo|por qué|en cuanto|eu|meu|minha|uso|usei|como mostro|quando)\b|J'|\?",
    re.I,
)
# Those of them, of one word, that no page of a site uses.
_TALK_WORDS = frozenset("i my mine how why ich wie warum je mon ma mes comment pourquoi cómo eu meu minha".split()) | {CODE}
_STRONG_TALK = re.compile(_TALK.pattern.replace("|me|", "|").replace("|too|fine|", "|"), re.I)


# Runs of neighbouring keys, typed for want of words, on the usual layouts.
_KEYS = ("asdf", "qwe", "sdf", "jkl", "uiop", "zxcv", "yxcv", "azer", "lkj", "fgh")
_MASH = re.compile(rf"^(?:{'|'.join(_KEYS)})[^\W\d_]{{0,6}}$")


class _Letters(dict):
    """Letters as they are, ends of lines and sentences kept, code a word of its own, everything else a blank."""

    def __missing__(self, code: int) -> int:
        self[code] = code if chr(code).isalpha() else 32
        return self[code]


_LETTERS = _Letters({10: 10, 1: 1, ord(CODE): f" {CODE} ", ord("|"): 1, ord("•"): 1, ord("·"): 1})
_SENTENCES = re.compile(r"(?<=[.?!])\s+")
_ENDS = re.compile(r"[.?!]+(?=\s)| - ")
_PLAIN = re.compile(r"[^\d_=/\\{}()\[\]<>#@*+|]*")


_has_runs = finder((*_KEYS, *(letter * 3 for letter in "abcdefghijklmnopqrstuvwxyz")))
_OTHER_THRICE = re.compile(r"([^\x00-\x7f])\1\1")


def _is_mashed(low: str) -> bool:
    """Whether there are runs of neighbouring keys or of one letter."""
    return _has_runs(low) or (not low.isascii() and bool(_OTHER_THRICE.search(low)))


def _as_words(low: str) -> list[str]:
    """The lines of a text as their words between blanks, sentences set apart by a sign of their own."""
    return _ENDS.sub("\x01", low).translate(_LETTERS).split("\n")


def _repeats(words: list[str]) -> bool:
    """Few words over and over, or letters over and over."""
    n = len(words)
    if n >= 2 and all(len(w) >= 3 and len(set(w)) == 1 for w in words):
        return True
    distinct = len(set(words))
    return n >= 3 and 2 * distinct <= n and (distinct <= 4 or 6 * distinct <= n) and max(Counter(words).values()) >= 3


def _says_nothing(words: list[str], mashed: bool, alone: bool, line: str) -> bool:
    """Mock Latin, repetition or runs of keys; three words over and over are enough only in a line of their own.
    ``line`` holds the words as they are written."""
    n = len(words)
    if n < 2 or CODE in words:
        return False
    if n >= 3 and not MOCK_LATIN.isdisjoint(words):
        latin = sum(w in MOCK_LATIN for w in words)
        if ("lorem" in words or "ipsum" in words) and (words[:2] == ["lorem", "ipsum"] or n >= 7) and FUNCTION_WORDS.isdisjoint(words):
            return True
        if 2 * latin >= n and latin >= 2 and (n >= 6 or 10 * latin >= 7 * n):
            return True
    if n >= 7 and FUNCTION_WORDS.isdisjoint(words):
        hard = sum(bool(_LATIN_HARD.search(w)) for w in words)
        if 5 * hard >= 2 * n and _PLAIN.fullmatch(line) and 20 * sum(bool(_LATIN.search(w)) for w in words) >= 13 * n:
            return True
    if 2 * len(set(words)) <= n or mashed:
        if _repeats(words) and (n > 3 or alone or mashed):
            return True
        return mashed and sum(w.startswith(_KEYS) and bool(_MASH.match(w)) for w in words) >= 0.7 * n
    return False


def is_filler(segment: str) -> bool:
    """Whether a sentence says nothing or announces a text instead of being one."""
    if CODE in segment:
        return False
    low = segment.lower()
    words = low.translate(_LETTERS).replace("\x01", " ").split()
    return _says_nothing(words, _is_mashed(low), True, segment) or (_announces(segment) and not _STRONG_TALK.search(segment))


def has_filler(own: str, low: str, lines: list[str]) -> bool:
    """Whether some line or sentence of a text is filler; ``low`` is it in lower case, ``lines`` its lines as words."""
    if _may_announce(low):
        for line in own.split("\n"):
            if _may_announce(line.lower()):
                for sentence in _SENTENCES.split(line):
                    if _announces(sentence) and (is_filler(sentence) or any(is_filler(s) for parts in segments(sentence) for s in parts)):
                        return True
    mashed = _is_mashed(low)
    latin = not MOCK_LATIN.isdisjoint(" ".join(lines).split())
    for written, line in zip(low.split("\n"), lines):
        sentences = line.split("\x01")
        alone = len(sentences) == 1
        if len(sentences) > 1:
            sentences.append(line.replace("\x01", " "))
        for sentence in sentences:
            words = sentence.split()
            n = len(words)
            # What says nothing repeats its words, or has such as no language has, or none of those that every language has.
            if n > 1 and (2 * len(set(words)) <= n or mashed or latin or (n > 6 and FUNCTION_WORDS.isdisjoint(words))) and _says_nothing(words, mashed, alone, written):
                return True
    return False


# ---------------------------------------------------------------------------------------------------------------------------
# Pages of servers and sites, and notices about scripts. A text is cut into lines, sentences and parts between bars and tags;
# each is strong if it says such a thing, furniture that comes with such pages, weak if it is in the words of such pages, or else
# words. All patterns below are fixed values: the standard phrases of servers, proxies, browsers and sites, by language.

_SCRIPTS = r"(?:java ?script|\bjs\b|\bscripts\b|\bscripting\b|\bskripte?n?\b|\bscript blocker\b|\bскрипт\w*)"
NOTICE = re.compile(
    rf"(?:\b(?:enabl\w+|turn(?:ed|ing)?|switch(?:ed|ing)?|activat\w+|allow\w*|unblock\w*|aktivier\w*|einschalt\w*|zulass\w*|activ\w+|habilit\w+|ativ\w+|permit\w*|permett\w*|abilit\w+|attiv\w+|inschakel\w*|schakel|włącz\w*|включит\w*)\b[^\n]{{0,40}}{_SCRIPTS}"
    rf"|{_SCRIPTS}[^\n]{{0,40}}\b(?:disabled|blocked|required|off|on|enabled|needed|necessary|cannot run|not (?:supported|available|enabled)|blocker|deaktiviert|blockiert|erforderlich|benötigt|nötig|aktivieren|einschalten|désactivé\w*|bloqués?|requis\w*|nécessaire|desactivado|bloqueados?|necesario|activado|desativado|necessário|ativado|disabilitat\w*|disattivat\w*|necessario|uitgeschakeld|vereist|nodig|wyłączon\w*|wymagan\w*|отключ\w*|необходим\w*)(?!\w)"
    rf"|\b(?:needs?|requires?|necessary|braucht|benötigt|erfordert|besoin de|nécessite|exige|necesita|requiere|precisa de|requer|richiede|necessario|vereist|wymaga|требует\w*)\b[^\n]{{0,25}}{_SCRIPTS}"
    rf"|\b(?:support|without(?: active)?|ohne(?: aktives)?|sans|sin|sem|senza|zonder|без|blocks?|blockiert|bloque|bloquea|bloqueia)\b[^\n]{{0,20}}{_SCRIPTS}|\bad ?-?blocker\b[^\n]{{0,40}}\b(?:keeps|disable|turn off)\b|\b(?:disable|turn off|pause)\b[^\n]{{0,20}}\bad ?-?blocker\b)",
    re.I,
)
#: A person who gives advice about scripts, beside those of _TALK.
_ADVICE = re.compile(r"\byou (?:can|could|should|might|may) (?:also )?(?:enable|allow|turn|switch|use|set|check|add)|\b(?:still|anyway|regardless|trotzdem|bleibt|funktioniert|reste|quand même|sigue|continua|im|in den|dans les|en los|nas) (?:einstellungen|paramètres|ajustes|configurações)\b", re.I)
_CODE_NUMBER = r"(?:4[0-5]\d|5[0-3]\d|10[0-3]\d)"
_STATUS_WORDS = (
    r"(?:not found|forbidden|denied|error|errors?|server|unavailable|gone|too many|requests?|gateway|time-?out|timed out|sign-?in|unauthori[sz]ed|no such|overloaded|blocked|bad request|maintenance|removed|no access|nothing"
    r"|nicht gefunden|nicht vorhanden|kein zugang|kein zugriff|verboten|fehler|zugriff verweigert|überlastet|gesperrt|introuvable|inexistante?|interdit|refusé|erreur|indisponible|surchargé|no encontrad[oa]|inexistente|prohibido|acceso|denegado|no disponible|não encontrad[oa]|proibido|acesso|negado|erro|indisponível"
    r"|non trovat[oa]|errore|vietato|negato|niet gevonden|geen toegang|fout|nie znaleziono|błąd|brak dostępu|не найден\w*|ошибка|доступ\w*|запрещ\w*)"
)
_THING = r"(?:page|site|website|resource|file|url|address|content|document|thread|topic|post|question|answer|discussion|item|account|link|host|server|location|seite|adresse|inhalt|thema|beitrag|dokument|ressource|sujet|contenu|página|sitio|contenido|tema|recurso|conteúdo|tópico|pagina|contenuto|risorsa|inhoud|strona|treść|страниц\w*|сайт\w*|ресурс\w*|файл\w*)"
_GONE = r"(?:not (?:be )?found|(?:can ?not|can't|could not|couldn't) (?:be )?(?:find|found|viewed|shown|displayed|reached|resolved|retrieved|made|loaded|opened|served|located|read|load|open)|(?:does not|doesn't) exist|no longer (?:be viewed|available|exists?|here)|(?:has been|have been|was|were|is) (?:removed|deleted|moved|suspended|blocked|disabled|gone|unavailable|down|private)|(?:is|are) (?:temporarily |currently |briefly )?(?:unavailable|not available|down|offline|closed))"
ERROR = re.compile(
    rf"(?:^(?:\W|error|http|status|code|fehler|erreur|erro|errore|fehlercode|código|ошибка)*\b{_CODE_NUMBER}\b(?=.{{0,60}}{_STATUS_WORDS})|^(?:http|error|status|fehler|erreur|erro|errore|błąd|ошибка)[ /:-]*(?:status |code |error )*{_CODE_NUMBER}\b|{_STATUS_WORDS}\W{{1,3}}(?:error |http |code |fehler |erreur |erro |errore |błąd |ошибка )?{_CODE_NUMBER}\)?\W*$"
    rf"|^\W*(?:{_THING} )?{_STATUS_WORDS}\W*$|\b{_THING}\b[^\n]{{0,60}}\b{_GONE}\b|^(?:sorry|oops|whoops|unfortunately)\b[^\n]{{0,60}}\b(?:{_GONE}|nothing was found)\b"
    r"|^\W*(?:error|fehler|erreur|erro|errore|błąd|ошибка)\b(?:\W+\w+){1,7}\W*$|\b(?:internal (?:server )?error|server error in|(?:web ?)?server (?:is down|error)|service (?:temporarily )?unavailable|bad gateway|gateway time-?out|upstream\b.{0,30}\b(?:answer|respond|error|timed)|(?:access|permission|connection|request) (?:is |was |has been )?(?:denied|refused|forbidden|rejected|reset|closed|timed out|blocked)|no such (?:page|thread|file|host|user|question|topic)|did not (?:answer|respond)|didn't respond|(?:application|fatal|runtime|unexpected|unknown|critical) error|an? (?:\w+ )?error (?:has |was )?(?:occurred|encountered|happened)|encountered an (?:\w+ )?error|unhandled exception|undefined function|headers?,? (?:output )?already sent|already sent \(line"
    r"|something (?:went|has gone) wrong|error establishing|bad request|not available in your|origin is down|blocked here|sign-?in (?:needed|required)|nothing to see|(?:could|can) ?not (?:find|read|load|open|reach|connect|show|display)|unable to (?:load|connect|find|open|access|complete|determine|process|display)|database (?:connection|error)|connection to the database|connection is not private|can.?t be reached|change you wanted was rejected|guru meditation|whitelabel error page|err_[a-z_]{4,}|net::\w+"
    r"|session (?:has )?(?:expired|timed out|ended)|(?:sign|log) ?in(?: again)? (?:to|first|before)(?: (?:continue|view|see|read|go on|access))?|(?:must|need to|have to) (?:be logged in|be signed in|log in|sign in|login)|please (?:log|sign) ?in|not (?:allowed|permitted|authori[sz]ed)(?: to (?:view|see|access|read))?|(?:no|do not have|don't have) (?:permission|access)|you (?:have been|are) (?:blocked|banned|unable to access)|(?:account|user|site) (?:has been |is )?(?:suspended|disabled|blocked)"
    r"|checking (?:your browser|if the site)|(?:making sure|verify\w*|checking|review)\b.{0,30}\b(?:connection|human|robot|browser|secure|security|safe)|(?:prove|verify|confirm) (?:that )?you are|not a robot|unusual traffic|automated (?:requests|queries)|security service to protect|one moment|just a moment|(?:down for|under|undergoing|scheduled|for) (?:\w+ )?maintenance|(?:come|be|check) back (?:in|later|soon|shortly)|slow down and|(?:retry|try again) (?:later|in|soon|shortly)|too many requests|rate limit (?:exceeded|reached)|browser is (?:out of date|not supported|outdated)|oops|whoops|no explicit mapping"
    r"|etwas (?:ist )?schiefgelaufen|später (?:erneut|noch einmal|wieder)|sitzung (?:ist )?abgelaufen|bitte (?:melden|loggen) sie sich|anmelden, um|nicht (?:angezeigt|gefunden|erreichbar|vorhanden|verfügbar|aufgerufen)|keine berechtigung|interner (?:server)?fehler|serverfehler|wartungsarbeiten|wegen wartung|wird gewartet|zugriff verweigert|kein zugang|kein roboter|verbindung wird geprüft|ihr browser wird"
    r"|session a expiré|page introuvable|est introuvable|erreur (?:interne|du serveur|serveur)|service indisponible|revenez plus tard|réessayez|connectez-vous|accès (?:refusé|interdit)|en maintenance|vérification de votre|pas un robot|n'existe (?:pas|plus)|(?:été|est) (?:supprimée?|déplacée?)|une erreur (?:est survenue|s'est produite)|quelque chose s'est mal"
    r"|sesión ha (?:caducado|expirado)|no (?:se ha )?encontrad[ao]|no existe|(?:sido|fue) (?:eliminad|movid)[ao]|error (?:interno|del servidor)|servicio no disponible|vuelva (?:más tarde|a intentarlo|luego)|inténtelo|inicie sesión|acceso (?:denegado|prohibido)|en mantenimiento|no es un robot|comprobando|(?:ha ocurrido|se produjo) un error|algo (?:ha salido|salió) mal|ya no existe"
    r"|sessão expirou|não (?:foi )?encontrad[ao]|não existe|foi (?:removid|movid|excluíd)[ao]|erro (?:interno|do servidor)|serviço (?:em manutenção|indisponível)|volte (?:depois|mais tarde)|tente novamente|faça login|entre para|acesso (?:negado|proibido)|em manutenção|não é um robô|verificando|ocorreu um erro|algo deu errado|já não existe|não existe mais"
    r"|non (?:è stata )?trovat[ao]|non esiste|stat[ao] (?:spostat|rimoss|eliminat)[ao]|errore (?:interno|del server)|accesso (?:negato|vietato)|riprova|sessione (?:è )?scaduta|in manutenzione|effettua (?:il login|l'accesso)|qualcosa è andato storto|si è verificato un errore"
    r"|niet gevonden|bestaat niet|geen toegang|toegang geweigerd|probeer het later|er is (?:een fout|iets fout)|sessie is verlopen|nie znaleziono|nie istnieje|odmowa dostępu|brak dostępu|spróbuj ponownie|wystąpił błąd|sesja wygasła|не найден\w*|не существует|доступ (?:запрещ|закрыт|ограничен)\w*|попробуйте позже|произошла ошибка|сессия истекла|внутренняя ошибка|удал[её]н[аоы]?)(?!\w))",
    re.I,
)
#: Navigation, waiting and whom to ask: what pages say beside their message, alone or run into it.
_NAVIGATION = (
    r"(?:(?:please |or |then |slow down and |and |you can |click here to )*(?:(?:go |return |get )?back(?: to (?:the |our |your )?(?:start|home|main|previous|front|last|safety)(?: ?page)?)?(?: or (?:try|use) the search)?|return to (?:the |our )?(?:start|home|main|previous|front)(?: ?page)?|(?:maybe )?(?:try|use) (?:the |our |a )?search|(?:reload|refresh)(?: (?:the|this|your) (?:page|browser))?|(?:allow|enable) (?:it|them) and (?:reload|refresh|continue|try again)|enable cookies(?! and)|if nothing happens"
    r"|(?:try again|retry|come back|check back)(?: (?:later|soon|shortly|in (?:an?|a few|some|\d+) (?:moments?|minutes?|seconds?|hours?|while)))?|wait(?: (?:a|one) (?:moment|minute|second))?)"
    r"|contact (?:the |your |our |us|site )?(?:[\w-]+ ){0,3}?(?:owner|administrator|admin|webmaster|support|team|provider)\b[^.!?\n]{0,80}"
    r"|(?:zur|zurück zur) (?:startseite|suche|übersicht)|retour à (?:l'accueil|la page d'accueil)|(?:volver|regresar|ir) (?:al inicio|a la página (?:principal|de inicio|anterior))|voltar (?:ao início|à página (?:inicial|principal|anterior))|torna(?:re)? (?:alla home(?: ?page)?|indietro))"
)
_MARK = r"(?:(?:request|error|ray|trace|correlation|incident|support)[ -]?id|reference|référence|referencia|referência|riferimento|kennung|incident|xid)\W{0,4}[\da-f][\da-f.-]{3,}"
_LINKS = r"(?:search|home|help|forum|log ?in|sign in|register|faq|about|contact|q ?& ?a|questions|answers|start|suche|hilfe|startseite|recherche|accueil|aide|buscar|inicio|ayuda|busca|início|ajuda|cerca|aiuto|menu|loading|laden|chargement|cargando|carregando)"
FURNITURE = re.compile(
    rf"^\W*(?:{_NAVIGATION}|{_MARK}|(?:id|ref|code)\W{{0,4}}[\da-f-]{{4,}}+|time\W{{1,3}}\d+ ?ms|[\w-]+/\d[\d.]*(?: \([^()\n]{{1,30}}\))?(?: server at \S+ port \d+)?|nginx|cloudflare|varnish(?: cache server)?|\d{{3}}|{_LINKS}(?:\W+{_LINKS}){{0,5}})?\W*$",
    re.I,
)
#: The same where it is run into the text around it.
FURNITURE_IN = re.compile(rf"(?:\b{_MARK}|\btime: \d+ ms|\b[a-z-]+/\d+(?:\.\d+)+|\b{_LINKS} \| {_LINKS}(?: \| {_LINKS})*\b|\b(?<!\bto ){_NAVIGATION}|\bq ?& ?a\b|(?<=[|-] )(?:forum|help)\b|\btraceback\b:?|\bat \w+ \(line \d+\))(?!\w)\W?", re.I)
#: Words of the sentences that go with an error; a sentence without one is somebody's.
_PAGE_WORD = re.compile(
    r"\b(?:page|site|website|server|request\w*|url|address|browser|resource|content|connection|network|cache|proxy|gateway|host\w*|cookies?|security|service|administrator|webmaster|owner|account|access\w*|permission|session|application|location|search|captcha|robot|human|traffic|maintenance|moment|minutes?|later|reload|refresh|retry|contact|support|logs?|details|unavailable|temporarily|denied|blocked|privacy|protect|attack\w*|extension|settings|feature|features|link|typed|visited|information|invalid|expired|error"
    r"|seite|adresse|verbindung|anfrage|zugriff|dienst|demandée?|adresse|connexion|serveur|requête|servidor|conexión|solicitud|dirección|conexão|solicitação|endereço|richiest[ao]|connessione|indirizzo|pagina|opgevraagde|adres|strona|serwer|страниц\w*|сервер\w*|адрес\w*|запрос\w*)\b",
    re.I,
)
#: Somebody explains: such words are no page's.
_EXPLAINS = re.compile(
    r"\b(?:returns?|means?|meaning|usually|often|because (?!you are seeing)|so (?:that|check|it|the|you|we)|instead|works?|worked|keep(?:s)? getting|fix(?:e[sd])?|set the|add (?:a|the)|run|restart|look (?:at|in)|whenever|e\.g|for example|as soon as|answers? (?:with )?\d|responds? with|except|unless|in (?:python|java|nginx|apache|php|excel|sql)|by default|still|update the|pass|use [^\W\d_]+"
    r"|liefert|weil|bedeutet|meistens|damit|trotzdem|renvoie|parce que|quand|signifie|devuelve|porque|cuando|significa|devolve|quando|restituisce|perché|dopo che)\b|\d[\d.,]* (?:rows|lines|zeilen|lignes|filas|linhas)\b",
    re.I,
)
# The fields of an error that a service answers with.
_ERROR_FIELDS = frozenset("error errors status code statuscode status_code message msg detail details title type reason ok success path timestamp instance traceid trace_id requestid request_id documentation_url error_description errorcode error_code fault description trace stack stacktrace exception".split())
_ERROR_SIGNS = frozenset("error errors message msg detail title reason code fault error_description".split())
# Every phrase of NOTICE, ERROR and LOADING holds one of these or a status number.
_STRONG_SIGNS = (
    "script|js|found|forbidden|denied|error|server|unavailable|gone|too many|request|gateway|time-out|timeout|timed out|sign-in|sign in|signed|login|log in|log-in|logged|unauthor|no such|overload|blocked|mainten|removed|no access|nothing"
    "|cannot|can not|can't|could not|couldn't|exist|no longer|deleted|moved|suspended|disabled| down|private|available|offline|closed|upstream|refused|reset|rejected|did not|didn't|exception|undefined|already sent|wrong|oops|whoops|unable|database|connection|reached|guru"
    "|whitelabel|err_|net::|expired|ended|permission|allowed|permitted|banned|checking|making sure|verify|review|human|robot|prove|confirm|unusual|automated|protect|moment| back|retry|try again|rate limit|out of date|supported|outdated|no explicit|not authori|have access|loading|wait"
    "|nicht|schiefgelaufen|später|sitzung|bitte|anmelden|berechtigung|fehler|wartung|gewartet|zugriff|zugang|geprüft|verboten|überlastet|gesperrt|laden|expiré|introuvable|erreur|indisponible|revenez|réessayez|connectez|accès|vérification|supprimé|déplacé|quelque chose|interdit|refusé|surchargé|inexistant|chargement"
    "|caducado|expirado|encontrad|eliminad|movid|vuelva|inténtelo|inicie|acceso|mantenimiento|comprobando|algo |prohibido|denegado|disponible|cargando|expirou|removid|excluíd|erro|volte|tente|entre para|acesso|manutenção|robô|verificando|negado|indisponível|proibido|carregando"
    "|trovat|esiste|spostat|rimoss|eliminat|errore|accesso|riprova|scaduta|manutenzione|effettua|storto|vietato|caricamento|gevonden|bestaat|toegang|probeer|fout|verlopen|znaleziono|istnieje|odmowa|dostępu|spróbuj|błąd|wygasła|найден|существует|доступ|запрещ|попробуйте|ошибк|истекла|удал|скрипт"
).split("|")
_may_be_page = finder(_STRONG_SIGNS)
_SOME_CODE = re.compile(rf"(?<!\d){_CODE_NUMBER}(?!\d)")
LONE_CODE = re.compile(rf"^\W*(?:https?|error|status|code|fehler|erreur|erro)?\W*(?:status|code|error)?\W*{_CODE_NUMBER}\W*$", re.I)
_NO_WORD = re.compile(r"\W+")
_XML_BEGIN = re.compile(r"(?i)\s*(?:<\?xml[^>]{0,200}>\s*)?<(error|fault|response)\b")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,100}>")
_SITE = re.compile(r"^\W*[A-Z][\w'&]*(?: [A-Z][\w'&]*){0,2}(?: (?:Forum|Help|Q ?& ?A|Community|Support|Hilfe|Aide|Ayuda|Ajuda))?\W*$")
_PARTS = re.compile(r"(?<=[.?!])\s+|\s+[|•·–—-]\s+|^[-*•]\s+")
LOADING = re.compile(r"^\W*(?:loading|please wait|one moment|laden|chargement|cargando|carregando|caricamento)\W*$", re.I)


def segments(text: str) -> list[list[str]]:
    """The lines of a text, each as its sentences and parts between bars, dashes and tags."""
    out = []
    for line in _TAG.sub("\n", text).split("\n"):
        line = re.sub(r"\s+([.,:;!?)])", r"\1", " ".join(line.split()))
        if line:
            parts = [p.strip(" -–—•·|*") for p in _PARTS.split(line)]
            out.append([p for p in parts if p])
    return [x for x in out if x]


def kind_of(segment: str) -> str:
    """'notice', 'error', 'code' (a status number), 'furniture', 'site', 'weak' or 'words'."""
    lone = LONE_CODE.match(_NO_WORD.sub(" ", segment))  # runs of other signs as one blank, so that the time is linear
    if CODE in segment:
        return "words"
    if lone:
        return "code"
    if FURNITURE.match(segment):
        return "furniture"
    talk = _STRONG_TALK.search(segment)
    if not talk and NOTICE.search(segment) and not _ADVICE.search(segment):
        return "notice"
    talk = talk or _EXPLAINS.search(segment)
    if not talk and ERROR.search(segment):
        return "error"
    if len(segment) < 40 and _SITE.match(segment):
        return "site"
    return "weak" if not talk and _PAGE_WORD.search(segment) else "words"


def _is_error_object(text: str) -> bool:
    """Whether a text is a service's error in JSON: an object of the usual fields only, or one such object in it."""
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return False
    if isinstance(value, dict) and len(value) == 1 and isinstance(inner := next(iter(value.values())), (dict, list)):
        inner = inner[0] if isinstance(inner, list) and inner else inner
        value = inner if isinstance(inner, dict) and next(iter(value)).lower() in _ERROR_SIGNS else value
    names = {k.lower() for k in value} if isinstance(value, dict) else set()
    return bool(names) and names <= _ERROR_FIELDS and not names.isdisjoint(_ERROR_SIGNS)


def _is_said(parts: list[str]) -> bool:
    """Whether a part is a sentence of somebody."""
    return any(CODE in s or (len(s.split()) > 6 and kind_of(s) == "words") for s in parts)


_FRAME = re.compile(r"(?im)^[^\S\n]*at\s+[\w.]+\s*\(line\s+\d+\s*\)[^\S\n]*$\n?")
_TRACE = re.compile(r"\btraceback\b", re.I)


def page_kind(text: str, own: str, lines: list[str]) -> str | None:
    """'error page' or 'script notice' if the text, beside a title, consists of such a page; ``lines`` are its own
    lines as words."""
    bare = text.strip()
    title, _, after = bare.partition("\n")
    for part in (bare, after.strip()):
        if part.startswith("<") and (m := _XML_BEGIN.match(part)) and part.lower().endswith(f"</{m[1].lower()}>"):
            return "error page"
        if part.startswith("{") and part.endswith("}") and _is_error_object(part):
            return "error page"
    trace = "raceback" in text.lower() and bool(_TRACE.search(text))
    if trace:
        own = own_words(_FRAME.sub("", text))  # the lines of a trace may be indented like code
    # Most texts end here: code or a person's words beside the first line are no page's.
    own, low = own.strip(), own.lower()
    if not trace and not _may_be_page(low) and not _SOME_CODE.search(low):
        return None
    if not trace and any(not _TALK_WORDS.isdisjoint(line.split()) for line in lines[1:]):
        return None
    body = own.partition("\n")[2] if "\n" in own else own
    if CODE in body or _STRONG_TALK.search(body):
        return None
    # So is a sentence beside the title that no page says; the first such one ends the reading.
    found: list[list[str]] = []
    for line in own.split("\n"):
        for parts in segments(FURNITURE_IN.sub("\n", line)):
            found.append(parts)
            if len(found) > 1 and _is_said(parts):
                return None
    if not found:
        return "error page" if trace or ERROR.search(own) else None
    if len(found) == 1 and _is_said(found[0]):
        return None
    kinds = [[kind_of(s) for s in parts] for parts in found]
    # Beside a status number or a trace, a few words are the page's.
    if trace or any("code" in line for line in kinds):
        few = 6 if trace else 5
        kinds = [["error" if k in ("words", "weak") and len(s.split()) <= few and CODE not in s and not _STRONG_TALK.search(s) else k for k, s in zip(line, parts)] for line, parts in zip(kinds, found)]
    for i in (0, 1):  # a site's name may be the first line, or follow the title
        if i < len(found) and kinds[i][0] in ("words", "weak") and len(found[i][0].split()) <= 3 and (i == 0 or len(found[i]) == 1):
            kinds[i][0] = "site"
    for skip in (0, 1):  # the first line may be a title
        flat = [k for line in kinds[skip:] for k in line]
        strong = [k for k in flat if k in ("notice", "error", "code")]
        # A page begins with its message; what goes with it may follow.
        begins = next((k for k in flat if k not in ("furniture", "site")), None)
        if strong and "words" not in flat and begins != "weak":
            return "script notice" if "notice" in strong else "error page"
    flat = [s for parts in found for s in parts]
    if any(map(LOADING.match, flat)) and all(LOADING.match(s) or kind_of(s) in ("furniture", "site") for s in flat):
        return "error page"
    return None


# ---------------------------------------------------------------------------------------------------------------------------


def residue_of(text: str | None) -> str | None:
    """'placeholder', 'filler', 'error page' or 'script notice', the first that applies; None for a clean text."""
    if not text or not text.strip():
        return None
    plain = normalise(text)
    own = own_words(plain)
    if open_slots(own, plain):
        return "placeholder"
    untagged = _TAG.sub("\n", own) if "<" in own else own
    low = untagged.lower()
    lines = _as_words(low.strip())
    if has_filler(untagged, low.strip(), lines):
        return "filler"
    return page_kind(plain, untagged, lines)


def mark_residue(df: DataFrame, text: str = "text", name: str = "residue") -> DataFrame:
    """``df`` with a column that says what residue a text is; null for clean texts."""
    while name in df.columns:
        name += "_"

    @F.pandas_udf("string")
    def classify(texts: pd.Series) -> pd.Series:
        return texts.map(residue_of)

    value = F.col(f"`{text}`").cast("string")
    # Residue needs a letter or a sign of a placeholder; a text without either stays in the JVM.
    return df.withColumn(name, F.when(value.rlike(r"[\p{L}{}\[\]<>%_$*]|\d{3}|&#"), classify(F.when(value.rlike(r"[\p{L}{}\[\]<>%_$*]|\d{3}|&#"), value))))


def without_residue(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text is not residue."""
    name = "__residue"
    marked = mark_residue(df, text, name)
    return marked.where(F.col(name).isNull()).drop(name)
