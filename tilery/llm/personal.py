"""Personal information inside free text: anchors found by Aho-Corasick, expanded by local parsers.

One automaton finds every anchor of a text in one pass: at-signs and their spellings, digits beside separators,
street words, labels, beginnings of comments and quotes, what people do, words one addresses or names people with, given names.
At each anchor a deterministic parser looks a bounded way to both sides (for numbers: over the whole field of digits,
blanks and ()-./+ it stands in, each field once), takes the boundaries of the mailbox, number, address or name, and
validates it. An address reaches up to 64 characters before its street word and 96 after. Found stretches that overlap
give way to the stronger kind, then to the longer. A text is read whole, whatever its length.

A name needs a label (`author:`) or a mailbox, number or address right beside it; else capital words of a person's shape are
scored by what speaks for a person: standing in a comment, a quoted field or at the beginning of a line; a word like `by` or
`thanks` before; a verb of doing something behind; a given name; words that the text has nowhere in lower case. POINTS of these are wanted.

Defined cases: null and empty texts hold nothing; the same stretch found twice in a text is kept twice here, with
its places; replacing leaves every other character as it is; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMAIL, PHONE, ID_NUMBER, ADDRESS, NAME = "EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME"
#: Stronger kinds first.
KINDS = (EMAIL, ADDRESS, ID_NUMBER, PHONE, NAME)

# Words that anchor or bound what is looked for.
AT_SPELLINGS = ("(at)", "[at]", "{at}", "<at>", " at ")
STREET_TYPES = ("Street", "St", "Road", "Rd", "Avenue", "Ave", "Boulevard", "Blvd", "Lane", "Ln", "Drive", "Dr", "Court", "Way", "Place", "Square", "Terrace")
STREET_OPENERS = ("Rue", "Via", "Calle", "Avenida", "Piazza", "Plaza", "Chemin", "Quai", "Boulevard", "Avenue", "Place", "Viale", "Corso", "Paseo", "Rua", "Allée", "Impasse")
STREET_ENDINGS = ("straße", "strasse", "str.", "gasse", "weg", "platz", "allee", "ufer", "damm")
UNITS = ("Apt", "Apartment", "Unit", "Suite", "Ste", "Flat", "Floor", "Room", "Rm")
NAME_LABELS = (
    "author", "authors", "written by", "maintainer", "maintained by", "reviewed-by", "signed-off-by", "acked-by", "tested-by",
    "co-authored-by", "reported-by", "contact", "ship to", "attn", "courtesy of", "fixed by", "reported by", "suggested by", "reviewed by", "approved by",
    "added by", "created by", "contributed by", "tested by", "todo(", "fixme(", "cc", '"name"', "'name'", "name", "owners", "owner", "copyright", "(c)", "©",
    "assigned to",
)
#: What stands before a person one speaks to or of; what a person does.
ADDRESSING = ("by", "to", "for", "from", "with", "ask", "asked", "thanks", "thank", "ping", "see", "per", "tell", "told", "call", "meet", "dear", "hi", "hello", "mr", "mrs", "ms", "dr", "prof", "and", "credits")
DOING = (
    "added", "agreed", "approved", "asked", "began", "broke", "brought", "built", "changed", "chose", "contributed", "created", "cleaned", "debugged", "decided", "did", "discovered",
    "documented", "drew", "explained", "fixed", "found", "gave", "helped", "implemented", "improved", "insisted", "introduced", "kept", "knows", "maintained", "maintains", "measured", "merged", "mentioned", "moved",
    "noticed", "owns", "pointed", "ported", "profiled", "proposed", "proved", "pushed", "put", "refactored", "removed", "renamed", "replaced", "reported", "requested", "reverted", "reviewed", "rewrote", "said", "saw",
    "says", "sent", "set", "showed", "spotted", "suggested", "tested", "thinks", "thought", "told", "took", "tracked", "tuned", "wants", "wrote",
)
COMPANY_WORDS = (
    "ab", "ag", "bv", "co", "collective", "company", "consortium", "corp", "corporation", "foundation", "gmbh", "group",
    "inc", "institute", "labs", "limited", "llc", "ltd", "oy", "partners", "project", "sa", "sarl", "se", "software", "solutions",
    "studio", "systems", "team", "technologies", "tooling", "university", "works",
)
#: A general lexicon, of many languages; names that are common words, places or products are left out.
GIVEN_NAMES = tuple(
    """
    Aaron Abdul Abdullah Abigail Adam Adele Adrian Agnes Ahmed Aiko Aisha Akira Alan Albert Alejandro Alessandro Alexander
    Alexandra Alexandre Alfred Alice Alicia Alina Allison Amanda Amara Amelia Amina Amir Amit Anastasia Anders Andrea
    Andreas Andrei Andrew Angela Anil Anita Anjali Anna Annika Ansel Antoine Anton Antonio Aoife Arjun Arthur Arturo Asha
    Astrid Barbara Beatrice Benjamin Bernard Birgit Bjorn Bogdan Brian Brielle Bruno Camille Carlos Carmen Caroline Caspian
    Catherine Cecilia Charles Charlotte Chiara Chinedu Christian Christina Christopher Claire Clara Claudia Clément Cristina
    Daniel Daniela Danielle David Deborah Deepak Denise Dennis Derek Diana Diego Dilan Dimitri Dmitri Dominik Donald Dorothy
    Douglas Edda Eduardo Edward Eileen Ekaterina Eleanor Elena Elif Elisabeth Elizabeth Emil Emily Emma Enrique Eric Erik
    Esther Eugene Evelyn Fatima Federico Felipe Fernando Fiona Francesca Francesco Francisco Franz François Frédéric Gabriel
    Gabriela Geoffrey George Gerald Gianluca Giovanni Giulia Giuseppe Gonzalo Gregory Greta Guillaume Gunnar Gustav Hanna
    Hannah Hans Harold Hassan Heather Heinrich Helen Helena Henrik Henry Hiroshi Hugo Héloïse Ibrahim Igor Ilse Ines Ingrid
    Irina Isabel Isabella Ivan Jacob Jacques Jakub James Jan Jane Jasmine Javier Jean Jennifer Jeremy Jessica Joanna Johan
    Johannes John Jonas Jonathan Jorge Jorun Joseph Joshua José João Juan Judith Jürgen Kamal Karen Karin Karl Katarina
    Katherine Kathleen Kenji Kenneth Kevin Khalid Klaus Kofi Kristina Krzysztof Kumar Lars Laura Laurent Leila Lena Leonardo
    Linda Linnea Lorenzo Louise Luca Lucas Lucia Ludwig Luis Luisa Lukas Magnus Mahmoud Malik Manuel Marcel Marco Marcus
    Marek Margaret Maria Marie Mario Marta Martin Martina Mateo Mathieu Matteo Matthew Matthias Maurice Mehmet Mei Melissa
    Mia Michael Michal Michel Michelle Miguel Mikhail Mira Mohamed Mohammed Monika Mustafa Nadia Nancy Naomi Natalia Natalie
    Natasha Nathan Neha Nicholas Nicolas Nicole Niklas Nikolai Nikolaus Nina Nisha Noah Noor Odile Olga Oliver Olivia
    Olivier Omar Oona Oscar Pablo Pamela Patricia Patrick Paul Paula Pauline Pavel Pedro Peter Petra Philip Philippe Pierre
    Piotr Pooja Priya Rachel Rafael Rahul Rajesh Ralph Ravi Raúl Rebecca Renata Ricardo Richard Robert Roberto Rodrigo Roger
    Roland Ronald Rosalind Ruben Ryan Samantha Samuel Sandra Sanjay Sara Sarah Satoshi Sean Sebastian Sergei Sergio Sharon
    Shreya Simon Sofia Solveig Sophie Stefan Stefano Stephanie Stephen Steven Sunita Suresh Susan Svetlana Sören Takeshi
    Tamsin Tatiana Teresa Theodore Theresa Thomas Timothy Tobin Tomasz Ulrich Valentina Valeria Vera Veronica Victor
    Victoria Vijay Vikram Vincent Vladimir Walter Wanjiru Werner William Wojciech Xavier Yasmin Yolanda Yuki Yusuf Yusuke
    Yvonne Zahra Zeynep Zofia
    """.split()
)
#: Where a comment begins.
COMMENTS = ("// ", "# ", "/* ", "* ", "-- ", "<!-- ")
#: What a name begins with, to be found behind an anchor.
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
#: Points that a name without a label needs.
POINTS = 3
_DOES = re.compile(
    rf"(?:,?[ ]and[ ](?:the|our|his|her|their|some)(?:[ ][a-z]+){{1,3}}?)?[ ](?:{'|'.join(DOING)}|[a-z]+ed)"
    r"(?:[ ](?:the|a|an|this|that|these|those|our|my|his|her|their|its|it|us|me|to|why|how|what|some|all|both|with|about|out|in|for|on)\b|[,.;:])"
)
_ADDRESSED = re.compile(rf"(?<![\w.-])(?:{'|'.join(ADDRESSING)})[.:]?[ ]$", re.I)
_ADDRESSED_OR_KEY = re.compile(rf"{_ADDRESSED.pattern}|\w:[ ]$", re.I)
_REMARK = re.compile(r"(?:^|[\s;{}(),])(?://+|#+|/\*+|--|<!--)[ \t]|^[ \t]*\*[ \t]|^[ \t]*$")
#: Capital words beside an address or in a comment that are no names of people.
NO_NAMES = frozenset(
    """access account active address admin agent api application back billing bug build cache channel client code collector column contact controller core customer daemon data database
    date default department desk drive editor email engine every feature fixed front garbage general head header help home index info key legal line list log mail mailing main manager
    memory message mobile new no node null office old open order orders our page parser phone please press primary privacy process product queue read record release report reports row
    sales scheduler security see send server service session shipping source staff store street support system table task tel telephone test the this thread to town unit update user
    version via visit web worker write your""".split()
)

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9_-])")
_DOT = r"(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?|\s+dot\s+)"
_SPELT_DOMAIN = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9-]{{0,62}}[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9-]{{0,62}}[A-Za-z0-9])?)*?{_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9_-])(?!{_DOT}[A-Za-z0-9])", re.I)
_PHONE = re.compile(
    r"""(?<![\w.+/-])(?:
      (?:\+|00)[1-9]\d{0,2}(?:[ ]?\(\d{1,5}\))?(?:[ ./-]?\d{1,12}+){1,6}
    | 1(?P<o>[- ])\(?[2-9]\d\d\)?(?:(?P=o)|[ ])[2-9]\d\d[- ]\d{4}
    | \([2-9]\d\d\)[ ]?[2-9]\d\d[-. ]\d{4}
    | [2-9]\d\d(?P<s>[-. ])[2-9]\d\d(?P=s)\d{4}
    | \(0\d{1,5}\)(?:[ /-]?\d{2,8}){1,3}
    | 0[1-9]\d{0,4}[ /-]\d{3,8}(?:[ -]\d{2,8}){0,2}
    )(?![\w/-]|\.\d)""",
    re.X,
)
_DIGIT_FIELD = re.compile(r"[0-9+()./ -]*")
_SOCIAL = re.compile(r"(?<![\w.+/-])\d{3}(?P<s>[- ])\d{2}(?P=s)\d{4}(?![\w/-]|\.\d)")
_INSURANCE = re.compile(r"(?<![A-Za-z0-9-])[A-Z]{2}(?P<s>[ ]?)\d\d(?P=s)\d\d(?P=s)\d\d(?P=s)[A-D](?![A-Za-z0-9-])")
_PASSPORT = re.compile(r"(?<![A-Za-z0-9-])[A-Z]{1,2}\d{7}(?![A-Za-z0-9-])")
_SOCIAL_LABEL = re.compile(r"(?:ssn|social security|s\.s\.n\.)[^\n]{0,16}$", re.I)
_CAP = r"[A-ZÀ-ÖØ-Þ]\w*(?:['’-]\w+)*"
_TOWN = rf"{_CAP}(?:[ ]{_CAP})?"
_POSTCODE = r"(?:\d{5}(?:-\d{4})?|[A-Z]{1,2}\d[A-Z\d]?[ ]?\d[A-Z]{2})(?![A-Za-z0-9])"
_PARTICLES = r"(?:(?:de|du|des|d'|della|dei|degli|del|di|da|la|las|le|les|los|l'|von|van|der|den|zur|zum|am|an)[ ]?){0,3}"
_OPENERS = "|".join(f"[{x[0]}{x[0].lower()}]{x[1:]}" for x in STREET_OPENERS)
_OPENER_BETWEEN = re.compile(
    rf"(?<![\w.,/-])\d{{1,4}}(?:[ ]?(?:bis|ter|[A-Za-z]))?,?[ ](?:{_OPENERS})[ ]{_PARTICLES}(?:{_CAP}[ ]?){{1,4}},[ ](?:{_POSTCODE}[ ]{_TOWN}|{_TOWN},?[ ]{_POSTCODE})"
)
_NUMBER_FIRST = re.compile(
    rf"(?<![\w.,/-])\d{{1,5}}[A-Za-z]?[ ](?:{_CAP}[ ]){{1,3}}(?:{'|'.join(STREET_TYPES)})\.?,[ ](?:(?:{'|'.join(UNITS)})\.?[ ]?\#?\w{{1,6}},[ ])?"
    rf"(?:{_TOWN},?[ ]{_POSTCODE}|{_POSTCODE}[ ]{_TOWN})"
)
_STREET_FIRST = re.compile(
    rf"(?<![\w-])(?:(?:{_OPENERS})[ ]{_PARTICLES}(?:{_CAP}[ ]){{1,3}}|(?:{_CAP}[ ])?[A-ZÀ-ÖØ-Þ]\w*(?:{'|'.join(map(re.escape, STREET_ENDINGS))})[ ])"
    rf"\d{{1,4}}[a-z]?,[ ](?:{_POSTCODE}[ ]{_TOWN}|{_TOWN},?[ ]{_POSTCODE})"
)
_ONE = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+"
_BIG = r"[A-ZÀ-ÖØ-Þ]{2,}"
_PERSON = (
    rf"(?:(?:{_ONE}|[A-ZÀ-ÖØ-Þ]\.)(?:[ ][A-ZÀ-ÖØ-Þ]\.)*[ ](?:Mc|Mac|O['’])?{_ONE}(?:-{_ONE})?"
    rf"|(?:{_BIG}|[A-ZÀ-ÖØ-Þ]\.)(?:[ ][A-ZÀ-ÖØ-Þ]\.)*[ ]{_BIG}(?:-{_BIG})?"
    rf"|{_ONE}(?:-{_ONE})?,[ ](?:{_ONE}|[A-ZÀ-ÖØ-Þ]\.)(?:[ ][A-ZÀ-ÖØ-Þ]\.)*"
    rf"|{_BIG}(?:-{_BIG})?,[ ](?:{_BIG}|[A-ZÀ-ÖØ-Þ]\.)(?:[ ][A-ZÀ-ÖØ-Þ]\.)*)(?![\w-])"
)
_PERSON_HERE = re.compile(_PERSON)
_PERSON_BEFORE = re.compile(rf"(?<![\w.'’-]){_PERSON}$")
_LABEL_GAP = re.compile(r"[\s:=\"'\[(*]*(?:\(c\)|©)?\s*(?:\d{4}(?:\s*[-–,]\s*\d{4})*,?\s+)?[\"'\[(]*", re.I)
_NEXT_WORD = re.compile(rf",?[ ](?:&[ ])?({_CAP})")
_ANOTHER = re.compile(r",?[ ](?:and|&)[ ]")

#: Between a name and a mailbox, number or address of the same person, to its right and to its left.
_TO_CONTACT = re.compile(r"[\"']?(?:[ \t]*[,;:|<(\[=–-]+|[ \t])[ \t]*(?:[a-z][a-z.-]{0,12}[ \t]?){0,3}[:=<(\[\"'+ \t]{0,4}")
_FROM_CONTACT = re.compile(r"[\"'>)\]]{0,2}[ \t]*[,;|(\[:–-]+[ \t]*[\"'(]?|[ \t]+\(")
_PAIR = re.compile(rf"(?<![\w.’@/-])(?<!\w'){_PERSON}")

Span = tuple[int, int, str]


def _email(text: str, at: int, end: int) -> Iterator[Span]:
    spelt = text[at:end] != "@"
    left = at
    if spelt:
        while left > 0 and text[left - 1] == " " and at - left < 2:
            left -= 1
    start = left
    while start > 0 and left - start < 64 and text[start - 1] in _LOCAL:
        start -= 1
    while start < left and not text[start].isalnum():
        start += 1
    if start == left or not text[left - 1].isalnum() or text[max(0, start - 3) : start] == "://":
        return
    right = end
    if spelt:
        while right < len(text) and text[right] == " " and right - end < 2:
            right += 1
    domain = (_SPELT_DOMAIN if spelt else _DOMAIN).match(text, right, min(len(text), right + 256))
    if not domain or not domain.group().rpartition(".")[2].rpartition(" ")[2].strip(")]}").isalpha():
        return
    if text[at:end].strip().lower() == "at" and "dot" not in domain.group().lower():
        return
    after = text[domain.end() : domain.end() + 2]
    if after[:1] in ("(", "/") or (after[:1] == ":" and len(after) > 1 and not after[1].isspace()):
        return  # a call, a path or a git remote
    yield start, domain.end(), EMAIL


def _field(text: str, at: int, end: int) -> tuple[int, int]:
    """The whole stretch of digits, blanks and ()-./+ around an anchor, whatever its length."""
    start = at
    while start > 0 and text[start - 1] in "0123456789+()-./ ":
        start -= 1
    return start, _DIGIT_FIELD.match(text, end).end()


def _numbers(text: str, start: int, stop: int) -> Iterator[Span]:
    """Numbers of a whole field: a part of one would cut those at its ends."""
    for m in _PHONE.finditer(text, start, stop):
        digits = sum(c.isdigit() for c in m.group())
        if 9 <= digits <= 15 and not (m.end() < len(text) and text[m.end()].isalnum()):
            yield m.start(), m.end(), PHONE
    for m in _SOCIAL.finditer(text, start, stop):
        never = m.group()[0] == "9" or m.group()[:3] in ("000", "666")
        if m.end() < len(text) and (text[m.end()].isalnum() or text[m.end()] == "-"):
            continue
        if never or m["s"] == "-" or _SOCIAL_LABEL.search(text[max(0, m.start() - 40) : m.start()]):
            yield m.start(), m.end(), ID_NUMBER


def _letters(text: str, at: int, end: int) -> Iterator[Span]:
    start = max(0, at - 2)
    for pattern in (_INSURANCE, _PASSPORT):
        for m in pattern.finditer(text, start, min(len(text), end + 16)):
            if m.start() <= at < m.end():
                yield m.start(), m.end(), ID_NUMBER


def _address(text: str, at: int, end: int) -> Iterator[Span]:
    low, high = max(0, at - 64), min(len(text), end + 96)
    for pattern in (_NUMBER_FIRST, _OPENER_BETWEEN, _STREET_FIRST):
        for m in pattern.finditer(text, low, high):
            if m.start() <= at < m.end():
                yield m.start(), m.end(), ADDRESS


def _is_person(text: str, start: int, end: int) -> bool:
    words = [w.strip(".,").lower() for w in text[start:end].split()]
    if any(w in COMPANY_WORDS for w in words):
        return False
    after = _NEXT_WORD.match(text, end, min(len(text), end + 40))
    if after is None:
        return True
    # a further capital word: the name of a company, unless a comma divides it off and it is none of its words
    return text[end] == "," and after.group(1).lower() not in COMPANY_WORDS


def _labelled(text: str, at: int, end: int) -> Iterator[Span]:
    if at > 0 and text[at].isalnum() and text[at - 1].isalnum():
        return
    gap = _LABEL_GAP.match(text, end, min(len(text), end + 40))
    start = gap.end()
    if (start == end and text[end - 1] != "(") or (text[at:end] in ("(c)", "(C)", "©") and not any(map(str.isdigit, gap.group()))):
        return  # the sign of a copyright has a year; else it is the third item of a list
    while True:
        m = _PERSON_HERE.match(text, start, min(len(text), start + 80))
        if not m:
            return
        if _is_person(text, m.start(), m.end()):
            yield m.start(), m.end(), NAME
        more = _ANOTHER.match(text, m.end())
        if not more:
            return
        start = more.end()


def _given(text: str, at: int, end: int) -> Iterator[Span]:
    if (at > 0 and (text[at - 1].isalnum() or text[at - 1] in "_-.'’@/")) or (end < len(text) and (text[end].isalnum() or text[end] in "_-@")):
        return
    m = _PERSON_HERE.match(text, at, min(len(text), at + 80))
    if m and "," not in m.group() and _is_person(text, m.start(), m.end()):
        yield m.start(), m.end(), NAME
        return
    low = max(0, at - 40)
    before = re.search(rf"(?<![\w.'’-])(?:{_ONE}(?:-{_ONE})?|{_BIG}(?:-{_BIG})?),[ ]$", text[low:at])
    if before:
        initials = re.compile(r"(?:[ ][A-ZÀ-ÖØ-Þ]\.)*").match(text, end)
        if _is_person(text, low + before.start(), initials.end()):
            yield low + before.start(), initials.end(), NAME


def _plausible(text: str, start: int, end: int) -> bool:
    """Whether capital words that neither a label nor a given name marks can be a person's."""
    words = [w.strip(".,").lower() for w in text[start:end].split()]
    return not text[start:end].isupper() and not any(w in NO_NAMES for w in words) and _is_person(text, start, end)


def _points(text: str, start: int, end: int) -> int:
    """What speaks for capital words being a person, 0 if something speaks against it."""
    if not _plausible(text, start, end):
        return 0
    low = max(0, start - 200, text.rfind("\n", max(0, start - 200), start) + 1)
    quoted = start > 0 and text[start - 1] in "\"'" and text[end : end + 1] == text[start - 1]
    points = int(quoted or _REMARK.search(text[low:start]) is not None)
    # people joined by `and` do it together
    last = end
    while (more := _ANOTHER.match(text, last)) and (other := _PERSON_HERE.match(text, more.end(), min(len(text), more.end() + 80))):
        last = other.end()
    does = _DOES.match(text, last, min(len(text), last + 60)) is not None
    # a key counts before what someone does: else it may be one of a product or place
    points += does + ((_ADDRESSED_OR_KEY if does else _ADDRESSED).search(text[max(low, start - 12) : start]) is not None)
    words = [w for w in re.split(r"[ ,]+", text[start:end]) if len(w) > 2 and not w.endswith(".")]
    points += 2 * any(w in _GIVEN for w in words)
    if points in (POINTS - 1, POINTS - 2):
        points += all(re.search(rf"(?<![\w.@+/-]){re.escape(w.lower())}(?![\w@+/-]|\.\w)", text) is None for w in words)
    return points


_GIVEN = frozenset(GIVEN_NAMES)


def _person_at(text: str, start: int) -> Iterator[Span]:
    """The person that begins at a place, and those joined to it."""
    while m := _PERSON_HERE.match(text, start, min(len(text), start + 80)):
        if "," not in m.group() and _points(text, m.start(), m.end()) >= POINTS:
            yield m.start(), m.end(), NAME
        more = _ANOTHER.match(text, m.end())
        if not more:
            return
        start = more.end()


def _opened(text: str, at: int, end: int) -> Iterator[Span]:
    """People behind what the anchor begins: a comment, a quote, or a word that names people; its last character is their first."""
    if text[at].isalnum() and at > 0 and (text[at - 1].isalnum() or text[at - 1] in "_-."):
        return
    yield from _person_at(text, end - 1)


def _acted(text: str, at: int, end: int) -> Iterator[Span]:
    """People before what they do, `and` and others between or not."""
    first, last = -1, -1
    for m in _PAIR.finditer(text, max(0, at - 100), at):
        if not (more := _ANOTHER.match(text, last)) or more.end() != m.start():
            first = m.start()
        last = m.end()
    if last == at or (last >= 0 and _DOES.match(text, last, min(len(text), end + 12))):
        yield from _person_at(text, first)


def _beside(text: str, at: int, end: int) -> Iterator[Span]:
    """People right before or after a mailbox, number or address, on its line."""
    low = max(0, at - 100, text.rfind("\n", max(0, at - 100), at) + 1)
    for m in _PAIR.finditer(text, low, at):
        if _TO_CONTACT.fullmatch(text, m.end(), at) and _plausible(text, m.start(), m.end()):
            yield m.start(), m.end(), NAME
    gap = _FROM_CONTACT.match(text, end, min(len(text), end + 8))
    m = gap and _PERSON_HERE.match(text, gap.end(), min(len(text), gap.end() + 80))
    if m and _plausible(text, m.start(), m.end()):
        yield m.start(), m.end(), NAME


def anchors() -> list[tuple[str, Callable]]:
    """Every anchor with its parser."""
    digits, out = "0123456789", [("@", _email)]
    cased = lambda x: {x, x.lower(), x.upper(), x.capitalize(), x[:1] + x[1:].capitalize(), x.title()}
    out += [(x, _email) for spelling in AT_SPELLINGS for x in cased(spelling)]
    out += [(a + s + b, _numbers) for a in digits for b in digits for s in "-. /"]
    out += [(a + b, _numbers) for a in "+(" for b in digits]
    letters = CAPITALS[:26]
    out += [(a + s + b, _letters) for a in letters for b in digits for s in ("", " ")]
    out += [(f" {x}{e}", _address) for x in STREET_TYPES for e in (",", ".,")]
    out += [(f"{x} ", _address) for x in (*STREET_OPENERS, *map(str.lower, STREET_OPENERS), *STREET_ENDINGS)]
    out += [(x, _labelled) for label in NAME_LABELS for x in cased(label)]
    out += [(f" {x} ", _acted) for x in DOING]
    out += [(opener + a, _opened) for opener in (*COMMENTS, '"', "'") for a in CAPITALS]
    out += [(f"{w}{gap}{a}", _opened) for x in ADDRESSING for w in {x, x.capitalize(), x.upper()} for gap in (" ", ": ", ". ") for a in CAPITALS]
    out += [(x, _given) for name in GIVEN_NAMES for x in (name, name.upper())]
    return out


class Finder:
    """The automaton with its parsers; made once in each task."""

    def __init__(self) -> None:
        import ahocorasick

        by_text: dict[str, list[Callable]] = {}
        for anchor, parser in anchors():
            parsers = by_text.setdefault(anchor, [])
            if parser not in parsers:
                parsers.append(parser)
        self.automaton = ahocorasick.Automaton()
        for anchor, parsers in by_text.items():
            self.automaton.add_word(anchor, (len(anchor), parsers))
        self.automaton.make_automaton()

    def spans(self, text: str | None) -> list[Span]:
        """Stretches (start, end, kind) in order, none overlapping another."""
        if not text:
            return []
        met: set[Span] = set()
        read = -1
        for last, (size, parsers) in self.automaton.iter(text):
            at, end = last + 1 - size, last + 1
            for parser in parsers:
                if parser is _numbers:
                    # one look at each field of digits, which is read whole
                    if read > at:
                        continue
                    at, end = _field(text, at, end)
                    read = end
                met.update(parser(text, at, end))
        for start, end, kind in [s for s in met if s[2] != NAME]:
            met.update(_beside(text, start, end))
        if len(met) < 2:
            return list(met)
        chosen: list[Span] = []
        taken: list[tuple[int, int]] = []
        from bisect import bisect_left

        for start, end, kind in sorted(met, key=lambda s: (KINDS.index(s[2]), s[0] - s[1], s[0])):
            k = bisect_left(taken, (start, end))
            if (k < len(taken) and taken[k][0] < end) or (k and taken[k - 1][1] > start):
                continue
            taken.insert(k, (start, end))
            chosen.append((start, end, kind))
        return sorted(chosen)

    def replaced(self, text: str | None) -> str | None:
        """The text with [KIND] in place of each stretch."""
        if text is None:
            return None
        out, at = [], 0
        for start, end, kind in self.spans(text):
            out += [text[at:start], f"[{kind}]"]
            at = end
        return "".join([*out, text[at:]])


def find_personal(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, begin, found_text): every stretch of personal information, begin counted in characters. Narrow."""
    kind = documents.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            row, kinds, begin, found = [], [], [], []
            for at, x in enumerate(batch.column("text").to_pylist()):
                for start, end, what in finder.spans(x):
                    row.append(at)
                    kinds.append(what)
                    begin.append(start)
                    found.append(x[start:end])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(row, pa.int32())), pa.array(kinds, pa.string()), pa.array(begin, pa.int32()), pa.array(found, pa.string())],
                names=["key", "kind", "begin", "found_text"],
            )

    source = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return source.mapInArrow(scan, f"key {kind}, kind string, begin int, found_text string").withColumnRenamed("key", key)


def replace_personal(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) with a placeholder of its kind for every stretch, everything else as it was. Narrow."""
    kind = documents.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            texts = [finder.replaced(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], names=["key", "text"])

    source = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = source.mapInArrow(scan, f"key {kind}, text string")
    return out.select(F.col("key").alias(key), F.col("text").alias(text))
