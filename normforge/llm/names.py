"""What a typed name says: its own words, the generic words around them, and how words compare."""

from __future__ import annotations

import functools
import re
import unicodedata

# Legal forms, lines of business with their short forms, regions and group wording, in lower case without dots.
LEGAL = "ab ag bv co company corp corporation gmbh inc incorporated kg kgaa limited llc llp ltd nv ohg oy oyj plc pty sa sarl sas se spa srl ug".split()
BUSINESS = (
    "automation autom controls control ctrls ctrl drives drive drv electronics electronic electr energy en engineering eng industries industry ind "
    "instruments instrument instr light measurement medical med networks network netw power pumps robotics robot sensors sensor sens software sw "
    "solutions solution sol systems system sys technologies technology tech test valves p&l t&m p&v d&c"
).split()
REGION = "deutschland europe france germany italia international int'l intl global worldwide usa uk asia".split()
GROUP = "group gruppe groupe holding holdings".split()
JOINING = "and und et & + the of".split()
GENERIC = frozenset(LEGAL + BUSINESS + REGION + GROUP + JOINING)
LONG_GENERIC = [g for g in sorted(GENERIC) if len(g) >= 4]


def letters(word: str) -> int:
    """A bit for each letter that occurs, letters beyond the alphabet shared."""
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 63)
    return out


#: Generic words that a word of so many letters may be a misspelling of: word, its letters, edits.
NEAR_GENERIC = {n: [(g, letters(g), 1 if n < 6 else 2) for g in LONG_GENERIC if abs(len(g) - n) <= (1 if n < 6 else 2) and (len(g) >= 6 or n < 6)] for n in range(4, 3 + max(map(len, LONG_GENERIC)))}
# Texts that name nobody.
NOBODY = frozenset(["", "-", "--", "?", ".", "n/a", "na", "nan", "nil", "none", "null", "unknown", "unbekannt", "inconnu", "multiple", "various", "various manufacturers", "several", "diverse", "tbd", "oem", "misc", "other", "not available", "undefined", "keine", "xxx"])
# Endings of host names.
ENDINGS = "com de org net info gov io uk eu nl fr test example invalid".split()

HOST = re.compile(rf"^(?:https?://)?(?:www\.)?([^\s/]+?)\.(?:{'|'.join(ENDINGS)})/?$", re.I)
REMARK = re.compile(r"\(([^()]*)\)")
RUN_TOGETHER = re.compile(r"(?:[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+){2,}")
CAPITAL = re.compile(r"(?=[A-ZÀ-ÖØ-Þ])")
SPLIT = re.compile(r"[\s,;/\\|_\-\"\[\]–]+")
GARBLED = re.compile("[ÂÃâã][\x80-\xbf ¡-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")
INVISIBLE = {0x200B: "", 0x200C: "", 0x200D: "", 0xFEFF: "", 0xAD: "", 0xA0: " ", 0xFFFD: ""}
DOTTED_LEGAL = re.compile(r"\b(?:[a-z]\.){1,3}[a-z]\.?(?=[\s,;)]|$)", re.I)


def repaired(text: str) -> str:
    """Text without invisible characters, its wrongly decoded UTF-8 read again."""
    for _ in range(2):
        if not GARBLED.search(text):
            break
        source = text.replace("ã", "Ã") if "Ã" not in text else text
        for code in ("latin-1", "cp1252"):
            try:
                text = source.encode(code).decode("utf-8")
                break
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
        else:
            text = GARBLED.sub("", text)
    return text.translate(INVISIBLE)


def folded(word: str) -> str:
    """Lower case without accents."""
    if word.isascii():
        return word.lower()
    plain = "".join(c for c in unicodedata.normalize("NFKD", word.casefold()) if not unicodedata.combining(c))
    return plain.replace("ß", "ss")


@functools.lru_cache(65_536)
def is_generic(word: str) -> bool:
    """A generic word, also if misspelt."""
    if word in GENERIC:
        return True
    own = letters(word)
    # an edit changes the sets of letters by two at most
    return any(osa(word, g, limit) <= limit for g, theirs, limit in NEAR_GENERIC.get(len(word), ()) if (own ^ theirs).bit_count() <= 2 * limit)


class Name:
    """The words of one typed name."""

    __slots__ = ("words", "short", "generic", "host", "remark")

    def __init__(self, text: str | None):
        text = repaired(text or "").strip()
        self.words: list[str] = []  # own words
        self.short: list[bool] = []  # whether the word was written as an abbreviation
        self.generic: list[str] = []
        self.remark, self.host = "", False
        if folded(text).strip(" .") in NOBODY or text.lower() in NOBODY:
            return
        remark = REMARK.search(text)
        if remark:
            self.remark = folded(remark.group(1))
            text = REMARK.sub(" ", text)
        text = text.strip(" \"'").lstrip(".")
        host = HOST.match(text.rstrip("."))
        if host:
            self.host = True
            text = host.group(1).replace(".", " ")
        else:
            text = DOTTED_LEGAL.sub(lambda m: m.group().replace(".", "").replace(" ", "") + " ", text)
        for piece in SPLIT.split(text):
            parts = [piece]
            if "." in piece.strip("."):
                parts = re.split(r"(?<=\.)", piece)
            for part in parts:
                dotted = part.endswith(".")
                core = part.strip(".:'")
                for word in [w for w in CAPITAL.split(core) if w] if RUN_TOGETHER.fullmatch(core) and folded(core) not in GENERIC else [core]:
                    low = folded(word)
                    if not low or not any(c.isalnum() or c in "&+" for c in low):
                        continue
                    if is_generic(low):
                        self.generic.append(low)
                    else:
                        self.words.append(low)
                        self.short.append(dotted and not self.host)


def osa(a: str, b: str, limit: int) -> int:
    """Edits, counting a swap of neighbours as one, that turn a into b; limit + 1 if more than the limit."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    # an edit changes the sets of letters by two at most
    if abs(n - m) > limit or len(set(a) ^ set(b)) > 2 * limit:
        return limit + 1
    before, row = None, list(range(m + 1))
    for i in range(1, n + 1):
        last2, before, row = before, row, [i] + [0] * m
        x = a[i - 1]
        low = row[0]
        for j in range(1, m + 1):
            y = b[j - 1]
            cost = before[j - 1] + (x != y)
            up = before[j] + 1
            if up < cost:
                cost = up
            left = row[j - 1] + 1
            if left < cost:
                cost = left
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and last2[j - 2] + 1 < cost:
                cost = last2[j - 2] + 1
            row[j] = cost
            if cost < low:
                low = cost
        if low > limit:
            return limit + 1
    return min(row[m], limit + 1)


def budget(word: str) -> int:
    """Edits within which a word still counts as the same."""
    return 0 if len(word) < 3 else 1 if len(word) < 5 else 2


def shortened(word: str, edits: int) -> set[str]:
    """The word with up to ``edits`` letters left out; words within so many edits of each other share one."""
    out = level = {word}
    for _ in range(edits):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return out


def word_similarity(a: str, b: str, a_short: bool = False, b_short: bool = False) -> float:
    """1 for equal words, less by edits; an abbreviation is as good as its share of letters allows."""
    if a == b:
        return 1.0
    limit = min(budget(a), budget(b))
    d = osa(a, b, limit) if limit else 9
    if d <= limit:
        return 1.0 - 0.8 * d / max(len(a), len(b))
    for x, y, dotted in ((a, b, a_short), (b, a, b_short)):
        if len(x) < len(y) and y.startswith(x) and (dotted or len(x) >= 3):
            return 0.86 if len(x) >= 3 else 0.8
    return 0.0
