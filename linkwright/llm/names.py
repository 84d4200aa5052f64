"""Names as people type them: their parts, and how two of them compare."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterable

#: Words that are no part of a name, and words that stand before a family name; a choice, to be set for other languages.
TITLES = frozenset("mr mrs ms miss mx dr prof rev sir".split())
SUFFIXES = frozenset("jr sr ii iii iv phd md esq".split())
PARTICLES = frozenset("van von der den de del la le da di mc mac o st".split())
#: Letters that Unicode doesn't decompose, and what they are compared as.
_LETTERS = str.maketrans({"ø": "o", "œ": "oe", "æ": "ae", "ß": "ss", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})

_WORD = re.compile(r"[^\W\d_]+")
_DROP = re.compile(r"['’`´]|(?<=[^\W\d_])[.-](?=[^\W\d_]{2})")
#: Digits that stand for letters inside words, as scans have them.
_DIGITS = str.maketrans("015", "ols")
_DIGIT_WORD = re.compile(r"(?<=[^\W\d_])[015]+(?=[^\W\d_])|(?<=[^\W\d_])[015]+$|^[015]+(?=[^\W\d_])")

#: How sure it is that two words are one name: the same, a usual other form, a slip of the pen, a cut-off form, an initial.
SAME, FORM, SLIP, CUT, INITIAL, NONE = 5, 4, 3, 2, 1, 0


@functools.lru_cache(200_000)
def fold(text: str) -> str:
    """Lower case without accents, and with m for rn, which scans don't tell apart."""
    t = unicodedata.normalize("NFD", text.lower()).translate(_LETTERS)
    return "".join(c for c in t if not unicodedata.combining(c)).replace("rn", "m")


@functools.lru_cache(200_000)
def words(text: str | None) -> tuple[str, ...]:
    """The folded words of a field, without titles and suffixes."""
    if not text:
        return ()
    plain = fold(text)
    if any(c.isdigit() for c in plain):
        plain = _DIGIT_WORD.sub(lambda m: m[0].translate(_DIGITS), plain)
    found = _WORD.findall(_DROP.sub(lambda m: " " if m[0] == "-" else "", plain))
    return tuple(w for w in found if w not in TITLES and w not in SUFFIXES)


@functools.lru_cache(500_000)
def edits(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words, or ``most + 1``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    older: list[int] = []
    old = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(old[j] + 1, new[-1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, older[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        older, old = old, new
    return min(old[-1], most + 1)


class Forms:
    """Usual other forms of given names, and all given names that they mention.

    ``given`` are names that stand for themselves: two of them are two names, however alike.
    """

    def __init__(self, pairs: Iterable[tuple[str, str]], given: Iterable[str] = ()) -> None:
        self.of: dict[str, set[str]] = {}
        for formal, other in pairs:
            f, o = fold(formal), fold(other)
            for x in _WORD.findall(f)[:1] + [f.replace("-", "")]:
                self.of.setdefault(o, set()).add(x)
                self.of.setdefault(x, set()).add(x)
        self.full = {*map(fold, given)}
        self.given = {*self.of, *self.full}

    def linked(self, a: str, b: str) -> bool:
        """One is a form of the other, or both are forms of one name."""
        x, y = self.of.get(a), self.of.get(b)
        if x is None:
            return y is not None and a in y
        return b in x if y is None else not x.isdisjoint(y)


def compare_words(a: str, b: str, forms: Forms) -> int:
    """How two words compare; a short one may be cut off or an initial of the other."""
    if a == b:
        return SAME
    if forms.linked(a, b):
        return FORM
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 1:
        return INITIAL if b[0] == a else NONE
    known = a in forms.given and b in forms.given
    if not known and len(a) >= 4:
        e = edits(a, b)
        if e == 1 or (e == 2 and len(a) >= 6):
            return SLIP
    if b.startswith(a) and not (a in forms.full and b in forms.full):
        return CUT
    return NONE


class Name:
    """The words of a last name and a first name, told apart by what is known of given names."""

    __slots__ = ("bare", "family", "given", "initials", "letters")

    def __init__(self, last: str | None, first: str | None, forms: Forms) -> None:
        l, f = list(words(last)), list(words(first))
        is_given = lambda w: w in forms.given
        if any(map(is_given, l)) and not any(map(is_given, f)):
            # the fields are exchanged, or all stands in one
            if f and not any(len(w) > 1 and not is_given(w) and w not in PARTICLES for w in l):
                l, f = f, l
            else:
                moved = [w for w in l if is_given(w)]
                if len(moved) < len([w for w in l if len(w) > 1]):
                    l, f = [w for w in l if w not in moved], moved + f
        elif not f and len([w for w in l if len(w) > 1]) > 1 and not any(map(is_given, l)):
            pass
        elif not l and len(f) > 1:
            moved = [w for w in f if is_given(w)]
            if moved:
                l, f = [w for w in f if w not in moved and len(w) > 1], moved + [w for w in f if len(w) == 1]
        self.initials = [w for w in l + f if len(w) == 1 and w != "o"]
        family = [w for w in l if len(w) > 1]
        self.family = [w for w in family if w not in PARTICLES] or family
        self.given = [w for w in f if len(w) > 1]
        self.bare = "".join(self.family)
        self.letters = ("".join(family + self.given), "".join(self.given + family))


def _best(xs: list[str], ys: list[str], forms: Forms) -> int:
    return max((compare_words(x, y, forms) for x in xs for y in ys), default=NONE)


_PREFIX = re.compile("^(?:vander|vonder|mc|mac|de|o|van|der)")


def compare_family(a: Name, b: Name, forms: Forms) -> int:
    """Level of two family names: whole, by parts, or without what stands before them."""
    if not a.family or not b.family:
        return NONE
    if a.bare == b.bare:
        return SAME
    x, y = _PREFIX.sub("", a.bare), _PREFIX.sub("", b.bare)
    if len(x) >= 4 and x == y:
        return FORM
    if min(len(x), len(y)) >= 5 and edits(x, y) <= 1:
        return SLIP
    if len(min(a.bare, b.bare, key=len)) >= 5 and edits(a.bare, b.bare) <= (1 if min(len(a.bare), len(b.bare)) < 6 else 2):
        return SLIP
    return _best(a.family, b.family, forms)


def _begins(given: list[str], initials: list[str], forms: Forms) -> bool:
    """A given name, or a name of which it is a form, begins with one of the initials."""
    return any(f[0] in initials for w in given for f in forms.of.get(w, {w}) | {w})


def compare_given(a: Name, b: Name, forms: Forms) -> int:
    """Level of two given names; initials count where no word does."""
    if a.given and b.given:
        level = compare_words(a.given[0], b.given[0], forms)
        if level == NONE:
            level = min(CUT, _best(a.given, b.given, forms))
        two = a.given[0] in forms.full and b.given[0] in forms.full
        if level == NONE and not two and edits("".join(a.given), "".join(b.given)) <= 1:
            level = SLIP
        return level
    if a.given and b.initials:
        return INITIAL if _begins(a.given, b.initials, forms) else NONE
    if b.given and a.initials:
        return INITIAL if _begins(b.given, a.initials, forms) else NONE
    if a.initials and b.initials:
        return INITIAL if set(a.initials) & set(b.initials) else NONE
    return NONE


def same_letters(a: Name, b: Name, forms: Forms) -> bool:
    """All words of one name run together are those of the other, in either order, but for a slip or two.

    Two given names that stand for themselves are two names all the same.
    """
    if a.given and b.given and a.given[0] != b.given[0] and a.given[0] in forms.full and b.given[0] in forms.full:
        return False
    y = b.letters[0]
    n = min(len(y), len(a.letters[0]))
    return n >= 8 and any(edits(x, y) <= (2 if n >= 12 else 1) for x in a.letters)
