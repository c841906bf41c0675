"""Organisation names typed by people: one form per name, and who is who.

parse() takes a name apart: kind of body, stem (the invented part), field of work, given name of a laboratory's head; legal
forms, places, order, case, marks and gluing are undone.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

# Fields of work and how people shorten them. "bio" and "inst" are shared by two.
FIELDS = {
    "biosciences": ("biosciences", "bioscience", "biosci", "bio sci", "bio"),
    "biologics": ("biologics", "biologic", "biol", "bio"),
    "technologies": ("technologies", "technology", "techn", "tech", "technol"),
    "instruments": ("instruments", "instrument", "instr", "inst", "instrum"),
    "laboratories": ("laboratories", "labs", "lab", "laboratory"),
    "pharmaceuticals": ("pharmaceuticals", "pharmaceutical", "pharma", "pharm"),
    "therapeutics": ("therapeutics", "therapeutic", "thera", "therap", "tx"),
    "diagnostics": ("diagnostics", "diagnostic", "diag", "dx", "diagn"),
    "proteomics": ("proteomics", "proteom", "prot"),
    "genomics": ("genomics", "genom", "gen"),
    "immunology": ("immunology", "immunol", "immuno", "imm"),
    "analytics": ("analytics", "analyt", "anal", "analytic"),
    "reagents": ("reagents", "reagent", "reag", "rgts"),
    "vaccines": ("vaccines", "vaccine", "vacc", "vax", "vac"),
    "bioprocess": ("bioprocess", "bioproc", "bp", "bioprocessing"),
    "medicine": ("medicine", "med", "medical"),
    "research": ("research", "rsch", "res"),
}
# Legal forms.
LEGAL = (
    "incorporated", "inc", "corporation", "corp", "company limited", "company", "co ltd", "co", "limited", "ltd", "llc", "l l c", "plc",
    "gmbh", "g m b h", "ag", "a g", "kk", "k k", "kabushiki kaisha", "sa", "s a", "se", "bv", "b v", "spa", "oy", "ab",
)
# Given names and their short forms.
NICKNAMES = {
    "william": ("bill", "will", "billy", "liam"), "robert": ("bob", "rob", "bobby", "bert"), "richard": ("rick", "dick", "rich", "richie"),
    "elizabeth": ("liz", "beth", "lizzie", "eliza", "betty"), "katherine": ("kate", "kathy", "kat", "katie", "kay"), "jennifer": ("jen", "jenny", "jenn"),
    "josephine": ("josie", "jo", "jojo"), "theodore": ("ted", "theo", "teddy"), "frederick": ("fred", "freddy", "rick"), "anthony": ("tony", "ant"),
    "margaret": ("maggie", "meg", "peggy", "marge"), "susanna": ("sue", "susan", "suzy", "susie", "anna"), "deborah": ("deb", "debbie", "debra"),
    "michael": ("mike", "mick", "mikey"), "alexander": ("alex", "sandy", "xander", "al"),
}
# Phrases that name nobody.
NOBODY = re.compile(
    r"^(?:|[-–—.?*/x]+|n\.?\s?/?\s?a\.?|n\.?d\.?|tb[acd]|none|null|nil|nobody|undisclosed.*|.*\bnot (?:disclosed|named|known|available|stated|applicable)\b.*|unnamed.*|unknown.*|"
    r"confidential.*|anonymous.*|withheld.*|several .*|various.*|multiple .*|many .*|other.*|others|to be .*|(?:a|an|another|some|one of) .*|leading .*|major .*|partner|client|customer|ditto|see .*|private.*|secret.*)$"
)

_SHORT: dict[str, set[str]] = {}
for _f, _forms in FIELDS.items():
    for _x in _forms:
        _SHORT.setdefault(_x, set()).add(_f)
_GLUED = sorted((x for x in _SHORT if " " not in x), key=len, reverse=True)
_GIVEN = {**{g: {g} for g in NICKNAMES}}
for _g, _ns in NICKNAMES.items():
    for _n in _ns:
        _GIVEN.setdefault(_n, set()).add(_g)
_LEGAL = sorted(LEGAL, key=len, reverse=True)
_GROUP = r"(?:laborator(?:y|ies)|labs?|research group|group)"
_TITLE = r"(?:(?:prof|professor|dr)\b)"
_JA = re.compile(r"[぀-ヿ㐀-鿿]")


def plain(name: str) -> str:
    """Lower case without marks, compatibility forms, odd spaces and most punctuation; ae, oe, ue for umlauts become a, o, u."""
    s = unicodedata.normalize("NFKC", name)
    s = "".join(c for c in s if unicodedata.category(c) != "Cf").lower()
    s = s.replace("ß", "ss").replace("ø", "o").replace("æ", "ae")
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not "̀" <= c <= "ͯ")
    s = re.sub(r"[’'`]s\b", "", s)
    s = re.sub(r"\s+", " ", s).strip()
    return unicodedata.normalize("NFC", s)


def stem_form(stem: str) -> str:
    """A stem by its letters only."""
    return re.sub(r"[^a-z]", "", stem)


def contracted(stem: str) -> str:
    """A stem with umlauts that are written out taken back."""
    return stem.replace("oe", "o").replace("ae", "a").replace("ue", "u")


#: Stems shorter than this are the same only if they are equal: a slip in them makes another name.
SLIP_LEAST = 6


def same_stem(a: str, b: str) -> bool:
    """Whether two stems are one but for one slip, umlauts written out or not."""
    if min(len(a), len(b)) < SLIP_LEAST:
        return a == b
    return near(a, b) or near(contracted(a), contracted(b))


def slips(stem: str) -> list[str]:
    """Keys of which two stems that are one but for a slip share at least one: the stem's two forms, each with one letter left out."""
    if len(stem) < SLIP_LEAST:
        return [stem]
    out = set()
    for x in {stem, contracted(stem)}:
        out.add(x)
        out.update(x[:i] + x[i + 1 :] for i in range(len(x)))
    return sorted(out)


@dataclass(frozen=True)
class Name:
    kind: str  # company, university, hospital, institute, center, person, alias, nobody
    stem: str = ""
    fields: frozenset[str] = frozenset()
    given: frozenset[str] = frozenset()
    initial: str = ""
    key: str = ""


def _field(word: str) -> set[str]:
    w = word.strip(" .").replace(".", "")
    return _SHORT.get(w, set())


def _cut_legal(s: str) -> str:
    while True:
        t = re.sub(r"[\s,.]+$", "", s)
        bare = re.sub(r"\.", " ", t)
        bare = re.sub(r"\s+", " ", bare).strip()
        for form in _LEGAL:
            m = re.search(r"(?:^|[\s,.-]+)" + r"[\s.,]*".join(re.escape(x) for x in form.split()) + r"\.?$", t)
            if m and m.start() > 0:
                s = t[: m.start()]
                break
        else:
            return t


def parse(name: str | None, case: str | None = None) -> Name:
    if name is None:
        return Name("nobody")
    s = plain(name)
    if NOBODY.match(s.strip(" .()[]\"'")):
        return Name("nobody")
    key = re.sub(r"[^\w]+", "", s)
    if _JA.search(s):
        return Name("alias", key=key)
    person = _person(s)
    if person is not None:
        return Name("person", stem_form(person[0]), given=frozenset(person[1]), initial=person[2], key=key)
    s = re.sub(r"\s*\([^()]*\)?\s*$", "", s)
    s = re.sub(r"^the\s+", "", s)
    s = _cut_legal(s)
    # "field, stem": what follows the comma is the stem
    m = re.match(r"^(.+?)\s*,\s*([a-z][a-z -]+)$", s)
    if m:
        head = m.group(1).strip(" .")
        if _body_words(head):
            s = m.group(2).strip() + " " + head
    s = re.sub(r"^the\s+", "", s)
    got = _body(s)
    if got is not None:
        kind, stem, fields = got
        return Name(kind, stem_form(stem), frozenset(fields), key=key)
    words = [w for w in re.split(r"[\s-]+", s) if w.strip(".")]
    if len(words) > 1:
        fields = _field(words[-1])
        if len(words) > 2 and not fields:
            fields = _SHORT.get(" ".join(w.strip(".") for w in words[-2:]), set())
            if fields:
                words = words[:-1]
        if not fields:
            fields = _near_field(words[-1])
        stem = stem_form("".join(words[:-1] if fields else words))
        return Name("company", stem, frozenset(fields), key=key) if stem else Name("alias", key=key)
    w = s.strip(".")
    for form in _GLUED:
        if w.endswith(form) and len(w) - len(form) >= 6 and (len(form) > 3 or _glued_case(name, form)):
            return Name("company", stem_form(w[: -len(form)]), frozenset(_SHORT[form]), key=key)
    # codes with digits are no stems
    if stem_form(w) and not any(c.isdigit() for c in w):
        return Name("company", stem_form(w), key=key)
    return Name("alias", key=key)


def _glued_case(name: str, form: str) -> bool:
    """Whether the glued part was typed with a capital of its own after a small letter."""
    return any(m.group(1).lower() == form for m in re.finditer(r"(?<=[^\W\d_A-Z])([A-Z]+[a-z]*)", name))


def _near_field(word: str) -> set[str]:
    w = word.strip(".")
    if len(w) < 7:
        return set()
    return {f for f in FIELDS if near(w, f, 1)}


def _body_words(head: str) -> bool:
    h = head.strip(" .")
    return bool(_field(h)) or h.replace(".", "") in ("bio sci",) or _body("stemname " + h) is not None or bool(_near_field(h))


_INST = r"inst(?:itute|itut|\.)?"
_CTR = r"(?:cent(?:er|re)|ctr\.?)"
_HOSP = r"hosp(?:ital|\.)?"
_UNIV = r"u(?:niv(?:ersity|\.)?|\.)?"


def _body(s: str):
    """(kind, stem, fields) of universities, hospitals, institutes and centres."""
    m = re.match(rf"^{_UNIV} of ([a-z -]+)$", s)
    if m:
        return "university", m.group(1), set()
    m = re.match(rf"^([a-z -]+?)[\s-]+{_UNIV}\s+{_HOSP}$", s)
    if m:
        return "hospital", m.group(1), set()
    m = re.match(rf"^([a-z -]+?)[\s-]+{_INST} (?:of|for) ([a-z.]+)$", s)
    if m and _any_field(m.group(2)):
        return "institute", m.group(1), _any_field(m.group(2))
    m = re.match(rf"^([a-z -]+?)[\s-]+{_CTR} (?:for|of) ([a-z.]+)$", s)
    if m and _any_field(m.group(2)):
        return "center", m.group(1), _any_field(m.group(2))
    m = re.match(rf"^([a-z -]+?)[\s-]+(?:research|rsch|res)\.?[\s-]+{_INST}$", s)
    if m:
        return "institute", m.group(1), {"research"}
    m = re.match(rf"^([a-z-]{{6,}}) ([a-z.]+)[\s-]+(?:{_INST}|{_CTR})$", s)
    if m and _any_field(m.group(2)):
        return "institute" if re.search(rf"{_INST}$", s) else "center", m.group(1), _any_field(m.group(2))
    m = re.match(rf"^(?:of )?([a-z-]{{6,}}),? {_UNIV}$", s) or re.match(rf"^of ([a-z-]+)\s*,\s*{_UNIV}$", s) or re.match(rf"^{_UNIV} ([a-z-]{{6,}})$", s)
    if m:
        return "university", m.group(1), set()
    m = re.match(rf"^([a-z-]{{6,}})[\s-]+{_UNIV}$", s)
    if m:
        return "university", m.group(1), set()
    return None


def _any_field(word: str) -> set[str]:
    return _field(word) or _near_field(word)


def _given(word: str) -> tuple[set[str], str]:
    """(full given names, initial) that a word can stand for."""
    w = word.strip(" .,()")
    if len(w) == 1:
        return set(), w
    return _GIVEN.get(w, set()), ""


def _person(s: str):
    """(surname, given names, initial) of a person's laboratory, or None."""
    titled = bool(re.match(rf"^{_TITLE}", s))
    t = re.sub(rf"^(?:{_TITLE}\.?\s*)+", "", s).strip()
    m = re.match(rf"^{_GROUP}\.? of (?:{_TITLE}\.?\s*)*(\S+) (\S+)$", t)
    if m:
        g, i = _given(m.group(1))
        if g or i:
            return m.group(2), g, i
    m = re.match(rf"^([a-z-]+),\s*([a-z]+\.?)\s*\({_GROUP}\.?\)$", t)
    if m:
        g, i = _given(m.group(2))
        if g or i:
            return m.group(1), g, i
    m = re.match(rf"^([a-z-]+) {_GROUP}\.?\s*\(([a-z]+\.?)\)$", t)
    if m:
        g, i = _given(m.group(2))
        if g or i:
            return m.group(1), g, i
    m = re.match(rf"^([a-z]+\.?) ([a-z-]+) {_GROUP}\.?$", t)
    if m:
        g, i = _given(m.group(1))
        if g or i:
            return m.group(2), g, i
    m = re.match(r"^([a-z]+\.?) ([a-z-]+)$", t)
    if m and titled:
        g, i = _given(m.group(1))
        if g or i:
            return m.group(2), g, i
    m = re.match(r"^([a-z-]+), ([a-z]+\.?)$", t)
    if m and (titled or _given(m.group(2))[0]):
        g, i = _given(m.group(2))
        if (g or i) and not _body_words(m.group(1)):
            return m.group(1), g, i
    return None


def near(a: str, b: str, most: int = 1) -> bool:
    """Whether a and b differ by at most `most` insertions, deletions, substitutions or exchanges of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, prev2[j - 2] + 1)
            cur.append(d)
        if min(cur) > most:
            return False
        prev2, prev = prev, cur
    return prev[-1] <= most
