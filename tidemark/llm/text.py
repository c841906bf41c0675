"""One consistent form of text: compatibility forms, marks, invisible characters, spaces, hyphens, look-alike letters."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that look like a Latin letter, which follows each.
CYRILLIC = dict(zip("аеорсухіѕјһԁԛԝѵАВЕКМНОРСТУХІЅЈԚԜ", "aeopcyxisjhdqwvABEKMHOPCTYXISJQW"))
GREEK = dict(zip("οΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oABEZHIKMNOPTYX"))
# Greek letters that resemble a Latin one but are written in scientific names; substituted only where the word is known.
GREEK_NAMES = dict(zip("αινρτυκχ", "aivptukx"))
LOOKALIKE = CYRILLIC | GREEK | GREEK_NAMES
CERTAIN = CYRILLIC | GREEK

# Compatibility characters that are ordinary typography and so no cases, but still folded.
ORDINARY = set("…´¨¯¸ªº")

_LETTERS = re.compile(r"[^\W\d_]+")
_FOREIGN = re.compile(r"[Ͱ-ϿЀ-ԯ]")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_EMOJI = re.compile(r"[←-⯿〰〽️⃣\U0001f000-\U0001faff♀♂]")
_HYPHENS = {0x2010: "-", 0x2011: "-", 0x2043: "-", 0xFE63: "-", 0xFF0D: "-"}
_CJK = re.compile(r"[、-ヿ㐀-鿿！-｠]")
_FULL_PUNCT = set("！＂＃＄％＆＇（）＊＋，－．／：；＜＝＞？＠［＼］＾＿｀｛｜｝～｡｢｣､･￥")

#: Java patterns of which every value that needs work matches one: an unusual character, a compatibility character of the
#: ordinary ranges, or a letter of another script beside a Latin one or parted from it by Japanese or Chinese letters only.
ODD = (
    r"[^\x{20}-\x{7e}\x{c0}-\x{17f}\x{370}-\x{52f}\x{2013}\x{2014}\x{2018}-\x{201e}"
    r"\x{3001}-\x{3011}\x{3041}-\x{3096}\x{309d}-\x{30fe}\x{4e00}-\x{9fff}]"
    r"|[\x{132}-\x{133}\x{13f}-\x{140}\x{149}\x{17f}\x{374}\x{37a}\x{37e}\x{384}-\x{385}\x{387}\x{3d0}-\x{3d6}\x{3f0}-\x{3f2}\x{3f4}-\x{3f5}\x{3f9}\x{309f}]"
)
#: What may lie between the two, and the two.
BETWEEN = r"[\x{3001}-\x{30fe}\x{4e00}-\x{9fff}]"
BESIDE_LATIN = r"[A-Za-z\x{c0}-\x{24f}]"
BESIDE_FOREIGN = r"[\x{391}-\x{3b1}\x{3b5}-\x{51d}]"
BESIDE = f"{BESIDE_LATIN}{BETWEEN}*{BESIDE_FOREIGN}|{BESIDE_FOREIGN}{BETWEEN}*{BESIDE_LATIN}"


def suspect(c: Column) -> Column:
    """Whether a value may need work; plain ASCII is settled by its length in bytes, without a pattern. False for null."""
    work = (F.octet_length(c) > F.char_length(c)) & (c.rlike(ODD) | c.rlike(BESIDE))
    return F.coalesce(work, F.lit(False))


def fold(text: str) -> tuple[str, set[str]]:
    """text without compatibility forms, loose marks, invisible characters, odd spaces and hyphens; and the kinds found.

    Joiners between emoji are kept. Full-width punctuation beside Japanese or Chinese text is ordinary there and kept.
    """
    kinds: set[str] = set()
    if text.isascii() and not any(c in text for c in "\t\n\r\x0b\x0c"):
        return text, kinds
    out: list[str] = []
    last = len(text) - 1
    for i, c in enumerate(text):
        o = ord(c)
        if o < 128:
            out.append(" " if c in "\t\n\r\x0b\x0c" else c)
            continue
        cat = unicodedata.category(c)
        if cat == "Cf":
            if o == 0x200D and 0 < i < last and _EMOJI.match(text[i - 1]) and _EMOJI.match(text[i + 1]):
                out.append(c)
            elif 0xE0020 <= o <= 0xE007F:
                out.append(c)
            else:
                kinds.add("invisible")
            continue
        if cat == "Zs":
            kinds.add("space")
            out.append(" ")
            continue
        if o in _HYPHENS:
            kinds.add("hyphen" if o != 0xFF0D else "compat")
            out.append("-")
            continue
        if o in (0x115F, 0x1160, 0x3164, 0xFFA0, 0x2800, 0x034F, 0x180B):
            kinds.add("invisible")
            continue
        if c in _FULL_PUNCT and _beside_cjk(text, i):
            out.append(c)
            continue
        n = unicodedata.normalize("NFKC", c)
        if cat == "So" and (n == c or o >= 0x1F000) or o in (0xFE0F, 0xFE0E):
            out.append(c)
            continue
        if n != c and unicodedata.normalize("NFC", c) == c:
            if c not in ORDINARY:
                kinds.add("compat")
            out.append(n)
            continue
        out.append(c)
    s = "".join(out)
    composed = unicodedata.normalize("NFC", s)
    if composed != s:
        kinds.add("marks")
    return composed, kinds


def _beside_cjk(text: str, i: int) -> bool:
    near = text[i - 1 : i] + text[i + 1 : i + 2]
    return any(_CJK.match(x) and not "０" <= x <= "ｚ" for x in near)


#: Latin letters and the Cyrillic ones that look like them.
TO_CYRILLIC = {latin: c for c, latin in CYRILLIC.items()}
_CYRILLIC = re.compile(r"[Ѐ-ԯ]")


def mixed_tokens(text: str) -> list[tuple[str, str, bool]]:
    """(token, a form of it in one script, certain) of each token of letters of several scripts that look-alikes explain.

    The dominant script of a token is that of most of its letters, Latin if two have as many. A token dominated by Latin has
    its Latin form, if all its other letters are look-alikes. One dominated by Cyrillic has its Cyrillic form, if all
    its Latin letters are look-alikes, and after that its Latin form, if its other letters are; neither is ever certain.
    certain: each substituted letter has no use of its own within Latin words, so that the form needs no proof.
    """
    if not _FOREIGN.search(text):
        return []
    found = []
    for m in _LETTERS.finditer(text):
        t = m.group()
        foreign, latin = _FOREIGN.findall(t), _LATIN.findall(t)
        if not foreign or not latin:
            continue
        cyrillic = _CYRILLIC.findall(t)
        dominant = len(latin) >= len(foreign)
        if not dominant and len(cyrillic) == len(foreign) and all(c in TO_CYRILLIC for c in latin):
            found.append((t, "".join(TO_CYRILLIC.get(c, c) for c in t), False))
        if all(c in LOOKALIKE for c in foreign):
            found.append((t, "".join(LOOKALIKE.get(c, c) for c in t), dominant and all(c in CERTAIN for c in foreign)))
    return found


def repaired(text: str, known: set[str]) -> tuple[str, bool, bool]:
    """(text, whether letters stood in for Latin ones, whether some of them without proof).

    Of a mixed token the first form that is in known (lower case) or certain takes its place; a certain form that isn't known is without proof.
    """
    forms: dict[str, str] = {}
    stood_in, unproven = False, False
    for t, form, sure in mixed_tokens(text):
        proven = form.lower() in known
        if t not in forms and (sure or proven):
            forms[t] = form
            if not _FOREIGN.search(form):
                stood_in, unproven = True, unproven or not proven
    return (_LETTERS.sub(lambda m: forms.get(m.group(), m.group()), text) if forms else text), stood_in, unproven


def repair(text: str, known: set[str]) -> str:
    """text as repaired() gives it."""
    return repaired(text, known)[0]


_SPACES = re.compile(r"\s+")


def squeeze(text: str) -> str:
    return _SPACES.sub(" ", text).strip()


def consistent(text: str) -> str:
    """text folded and repaired where certain, in its own case."""
    return repair(fold(text)[0], set())


def comparable(text: str) -> str:
    """The form in which texts are compared: folded, repaired where certain, in lower case."""
    return consistent(text).lower()


@F.pandas_udf(T.StringType())
def _comparable(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else comparable(x))


def comparable_column(c: Column) -> Column:
    """comparable() for a column; Python sees only the values that need it. Null stays null."""
    return F.coalesce(_comparable(F.when(suspect(c), c)), F.lower(c))


#: Java pattern of the separators between words (words: runs of letters and digits).
NOT_WORD = r"[^\p{L}\p{N}]+"


def word_hashes(c: Column) -> Column:
    """array<bigint>: a 64-bit hash of each word of comparable text, in order; empty for null or no words."""
    words = F.array_remove(F.split(c, NOT_WORD), "")
    return F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))
