"""Texts that were decoded with the wrong character encoding: finding and restoring them.

Method: best-first search over encode, decode and unescape operations. A state is a text; its cost is the
implausibility of its characters where they stand; states seen before are recognised by hash, and the cheapest open
state is expanded next. A stretch of text is a case if, and only if, the search reaches a clearly cheaper text. The
costs of letters beside each other come from a trained model (:mod:`dumpquarry.llm.letters`), those of other
characters from their Unicode categories. Characters that only a lossy decoding leaves behind are undone by an
operation of their own, which drops them: it tells the case, but what was lost is not written anew.
"""

from __future__ import annotations

import heapq
import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dumpquarry.llm.letters import VOCABULARIES, Letters, letters, of_one_language, script

#: Encodings with which text may have been decoded by mistake, and those it may have been written in.
WRONG = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866", "cp1250", "iso8859_2", "cp1254", "iso8859_15", "gbk", "cp932", "big5", "euc_kr")
WRITTEN = ("utf_8", "cp1252", "cp1251", "koi8_r", "cp866", "iso8859_5", "cp1250", "iso8859_2", "cp1254", "mac_roman", "cp437", "cp850", "cp932", "euc_jp", "gbk")
_TWO_BYTES = ("gbk", "cp932", "big5", "euc_kr", "euc_jp")
#: A text is taken only if it is cheaper by so much, after the prices of the operations, and leaves at most this share of the cost.
GAIN, SHARE_LEFT = 0.9, 0.6
#: A state leads on only if it costs at most this share of the one before and, after more than repairs of UTF-8, only if the best text could still fall by this share of the first cost.
FALL, LEAST_FALL = 0.8, 0.1
#: Characters of candidate texts after which the search of a stretch ends, so that garbage of no encoding ends too; every single operation is tried whatever their length.
WORK = 1_000_000
#: What rare letters and neighbours may cost in any proper text: so much as a whole, and so much for each letter beyond ASCII.
FREE_COST, FREE_LETTER = 0.9, 0.12
#: A found text is written as restored if, but for what was lost, it costs at most so much or this share of the cost before; else it stays as it is.
WRITE, WRITE_SHARE = 2.5, 0.05
#: What letters cost that no one language has together.
MIXED = 1.5
#: Characters that only a lossy decoding leaves behind: C1 controls, the replacement character, private use.
_LOST = re.compile(r"[\x80-\x84\x86-\x9f\ufffd\ue000-\uf8ff]")
_CHUNK = re.compile(r"(?:[A-Za-z]|[^\x00-\x7f\s])+")
_OTHER = re.compile(r"[^\x00-\x7f]")
#: First bytes of UTF-8 sequences as the common single-byte encodings show them.
_LEADS = frozenset("âÂÃÅÐÑÄãðƒ")
#: Characters that show with others as one, and are no letters of a word.
_JOINERS = frozenset("\u00ad\u200b\u200c\u200d\ufeff\ufe0f\u2060")
#: Scripts written without spaces, beside which words of others may stand.
_UNSPACED = frozenset(("KANA", "CJK", "THAI", "LAO", "KHMER", "MYANMAR", "TIBETAN", "HANGUL"))

_MASKS = [
    re.compile(r"[“\"„«‘`'][^\x00-\x7f\s]{1,4}[”\"“»’`']"),  # cited between quotation marks or as code
    re.compile(r"[^\x00-\x7f\s]{1,4}(?= instead of )"),
    re.compile(r"(?<=[Ss]ign )\ufffd|(?<=[Ss]ymbol )\ufffd|(?<=[Cc]haracter )\ufffd"),
]
_SEGMENT = re.compile(r"[^\n]*?(?:[.!?:;]\s+|\n|\Z)")
_CLITIC = re.compile("[^\\x00-\\x7f’‘](?=(?:s|t|ve|re|ll|d|m)\\b)")


@lru_cache(100_000)
def _kind(c: str) -> str:
    """letter, mark (joins the letter before), open and close (stand before and after words), symbol, box, other."""
    category = unicodedata.category(c)
    if c in "ˆˇ":
        return "symbol"
    if c == "ⁿ":
        return "close"
    if c in _JOINERS or category[0] == "M" or category in ("Lm", "Cf"):
        return "mark"
    if 0x2500 <= ord(c) < 0x25A0:
        return "box"
    if category in ("Ll", "Lu", "Lt", "Lo") and c not in "ªº":
        return "letter"
    if category == "Nd":
        return "picture"
    if category in ("Pi", "Ps", "Sc") or c in "¿¡§№":
        return "open"
    if category in ("Pf", "Pe", "Pd", "No") or c in "ªº…·‰′″°™®©":
        return "close"
    if ord(c) >= 0x1F000 or 0x2600 <= ord(c) < 0x27C0 or category == "Nl" or 0x2150 <= ord(c) < 0x2190:
        return "picture"
    return "symbol" if category[0] in "SP" else "other"


_AT_BOTH_ENDS = frozenset("”“’‘»«„€£¥–—…±×°·")


_NONE: frozenset[str] = frozenset()


@lru_cache(200_000)
def _chunk_cost(chunk: str, vocabularies: tuple[str, ...] = VOCABULARIES) -> tuple[float, float, int, frozenset[str]]:
    """Implausibility of one unbroken run of letters and other characters beyond ASCII: of what no proper text holds, and of rare letters and neighbours; the number of letters beyond ASCII, and those of Latin script."""
    model = letters(vocabularies)
    cost = sum(1.0 if c < "\xa0" else 3.0 for c in _LOST.findall(chunk))
    chunk = _LOST.sub("", chunk)
    a, b = 0, len(chunk)
    while a < b and (chunk[a] in _AT_BOTH_ENDS or (not chunk[a].isascii() and _kind(chunk[a]) in ("open", "mark", "picture") and chunk[a] != "\xad") or chunk[a] in "×±©°¬"):
        a += 1
    while b > a and (chunk[b - 1] in _AT_BOTH_ENDS or (not chunk[b - 1].isascii() and _kind(chunk[b - 1]) in ("close", "mark", "picture", "open") and chunk[b - 1] != "\xad" and not (_kind(chunk[b - 1]) == "open" and unicodedata.category(chunk[b - 1]) != "Sc"))):
        b -= 1
    inner = chunk[a:b]
    if a and inner and chunk[a - 1] in "–—" and not inner[0].isascii():
        cost += 1
    # a mark of its own kind among edge characters: two and more in a row are no typography
    if a + len(chunk) - b >= 3 and not all(unicodedata.category(c) in ("Ps", "Pe", "Mn", "Cf", "So", "Sk", "Lm", "Nd", "Nl") or c in "…–—·" for c in chunk[:a] + chunk[b:]):
        cost += 0.5 * (a + len(chunk) - b - 2)
    if not inner or inner.isascii():
        return cost, 0.0, 0, _NONE
    if len(inner) == 1 and _kind(inner) == "box" and chunk != inner:
        return cost + 1, 0.0, 0, _NONE
    if len(inner) == 1:
        return cost + (1.5 if inner in "âÂÃ" and chunk != inner else 1.0 if inner in "ÂÃ" else 0.0), 0.0, 0, _NONE
    hard, soft, n = _inner_cost(inner, model)
    return cost + hard, soft, n, frozenset(_BEYOND.findall(_NAME.sub(" ", inner).lower()))


_FULL_WIDTH = frozenset(map(chr, [*range(0x3000, 0x3020), 0x30FB, *range(0xFF01, 0xFF10), *range(0xFF1A, 0xFF21), 0xFF5E]))
_EAST = re.compile("[぀-ヿ㐀-鿿가-힣]")
_STRAIGHT = frozenset("─│━┃═║┄┆╌")


def _inner_cost(inner: str, model: Letters) -> tuple[float, float, int]:
    """The costs of what is left of a run without the characters at its edges that adjoin words."""
    cost, soft, n = 0.0, 0.0, 0
    before, low, kind = "", "", ""  # the character before, in lower case, and its kind
    seen: dict[str, int] = {}
    named = inner[1:].isascii() and inner[0].isupper()  # a capital before plain letters: a name
    last = len(inner) - 1
    for i, c in enumerate(inner):
        this = "letter" if c.isascii() else _kind(c)
        if this == "mark":
            if "\u0302" <= c <= "\u036f" and before.isascii() and before.isalpha() and len(unicodedata.normalize("NFC", before + c)) > 1:
                cost += 1  # no letter has this mark
            if c == "\xad" and (before in _LEADS or not before.isalpha() or i == last):
                cost += 1
            continue
        lower = c.lower()[:1] if this == "letter" else c
        if this == "letter":
            of = "LATIN" if c.isascii() else script(c)
            seen[of] = seen.get(of, 0) + 1
            n += not c.isascii()
            if kind == "letter" and not (c.isascii() and before.isascii()):
                other = "LATIN" if before.isascii() else script(before)
                if (other == of or (other in _UNSPACED and of in _UNSPACED)) and not named:
                    if lower in model.known:
                        soft += model.neighbour(lower, low, False)
                    if low in model.known:
                        soft += model.neighbour(low, lower, True)
                if c.isupper() and before.islower():
                    cost += 2
                elif i > 1 and c.islower() and not c.isascii() and before.isupper() and inner[i - 2].isupper():
                    cost += 1
            elif kind == "" and not c.isascii() and i == 0 and not named and lower in model.known and of not in _UNSPACED:
                soft += model.neighbour(lower, " ", False)
            if of in ("CJK", "HANGUL") and before.isascii() and before.islower() and "a" <= inner[i + 1 : i + 2] <= "z":
                soft += 1  # one ideograph within a word of plain letters
            if not c.isascii() and not named and model.strange(lower):
                soft += 0.5 if of == "HANGUL" else 1.0
            if 0xFF61 <= ord(c) <= 0xFF9F:
                cost += 1
        elif this == "box":
            if kind == "box":
                cost += 0.0 if c == before or c in _STRAIGHT or before in _STRAIGHT or (c >= "▀" and before >= "▀") else 1.0
            if kind == "letter" or inner[i + 1 : i + 2].isalpha():
                cost += 2
        elif this in ("open", "close") and c in "’‘–—…“”„·" and kind == "letter" and i < last:
            if before in _LEADS or (c in "–—" and not before.isascii()):
                cost += 2
            elif c == "’":  # an ending of up to three letters, or a short word before a vowel
                cost += 0.0 if last - i <= 3 or i <= 3 else 0.4
            elif c == "·":
                cost += 0.0 if before in "lL" else 1
            else:
                cost += {"“": 1, "”": 1, "„": 1, "‘": 0.5, "—": 0.3, "–": 0.3}.get(c, 0.0)
        elif c in _FULL_WIDTH:  # stands between words of scripts written without spaces
            cost += 0.0 if i in (0, last) or _EAST.search(inner) else 1.5
        elif this != "picture":
            if before == "" and (c in "†‡•→←" or (this == "close" and _EAST.search(inner))):
                pass
            elif before == "" and inner[1:].isascii():
                cost += 1
            else:
                cost += 1.5  # a symbol, or a mark that stands within a word
        before, low, kind = c, lower, this
    names = {s for s in seen if s and s not in _UNSPACED and s != "LATIN"}
    if "LATIN" in seen and names:
        cost += 1.5 * min(seen["LATIN"], sum(seen[s] for s in names))
    if soft > 0.5 and n > 2 and n == len(inner) == seen.get("LATIN"):
        cost += 1  # no plain letter among at least three
    if len(names) > 1:
        cost += 1.5 * min(seen[s] for s in names)
    if inner[-1] in "ÂÃ" and last and not (inner.isupper() and len(inner) > 2):
        cost += 1.5
    return cost, soft, n


def cost(text: str, vocabularies: tuple[str, ...] = VOCABULARIES, limit: float = math.inf) -> float:
    """Implausibility of a text's characters; near 0 for proper text, also with rare characters used properly. Cited sequences are left out.

    Where it is beyond ``limit``, any number beyond that may come out.
    """
    if text.isascii():
        return 0.0
    text = _masked(text)
    total, rare, letters_seen = 0.0, 0.0, 0
    latin, begins = _NONE, False
    for chunk in _CHUNK.findall(text):
        if not chunk.isascii():
            hard, soft, n, beyond = _chunk_cost(chunk, vocabularies) if len(chunk) < 100 else _chunk_cost.__wrapped__(chunk, vocabularies)
            total, rare, letters_seen = total + hard, rare + soft, letters_seen + n
            if total > limit:
                return total
            latin = latin | beyond
            begins = begins or not chunk[0].isascii()
    total += max(0.0, rare - FREE_COST - FREE_LETTER * letters_seen)
    if latin and not of_one_language(latin):
        total += MIXED
    if begins and latin and (enclosed := [m.groups() for m in _ENCLOSED.finditer(text) if m[1] != m[2]]):
        total += sum(n for n in Counter(enclosed).values() if n > 1)
    if "\xa0" in text:
        total += 3 * (text.count("Â\xa0") + text.count("Ã\xa0")) + 0.8 * len(_GAP.findall(text))
    return total + 1.5 * _clitics(text)


def _masked(text: str) -> str:
    """The text without the sequences that it only cites."""
    text = _MASKS[0].sub(" ", text)
    if " instead of " in text:
        text = _MASKS[1].sub(" ", text)
    return _MASKS[2].sub(" ", text) if "\ufffd" in text else text


#: Words that begin and end with a letter beyond ASCII: several alike are words in quotation marks read wrongly.
_ENCLOSED = re.compile(r"(?<!\w)([^\W\d_a-zA-Z])[a-z_]{3,}([^\W\d_a-zA-Z])(?!\w)")
#: Letters of Latin script beyond ASCII, and names: a capital among them before plain letters.
_BEYOND = re.compile("(?<=[^\\W\\d_])[ß-öø-ɏḀ-ỿ]|[ß-öø-ɏḀ-ỿ](?=[^\\W\\d_])")
_NAME = re.compile("(?<![A-Za-zÀ-ÖØ-öø-ɏ])[À-ÖØ-Þ][a-z]+(?![À-ÖØ-öø-ɏ])")
#: A no-break space within what seems to be a word.
_GAP = re.compile("(?<=[a-z])\\xa0(?=[a-z])")


#: What the bytes of an apostrophe show as where they are read in a wrong single-byte encoding.
def _apostrophes() -> frozenset[str]:
    out = set()
    for written in ("cp1252", "mac_roman"):
        byte = "’".encode(written)
        for wrong in WRONG:
            if wrong not in _TWO_BYTES:
                try:
                    out.add(byte.decode(wrong))
                except UnicodeDecodeError:
                    pass
    return frozenset(out - {"’", "‘"})


_APOSTROPHES = _apostrophes()
_ENGLISH = re.compile(r"\b(?:the|of|is|was|with|from|why|don|before|after|see|each|which|note|it|we)\b", re.I)


def _clitics(text: str) -> int:
    """Wrong apostrophes between a word and an English ending, in a text with English function words."""
    found = sum((m[0] in _APOSTROPHES or not m[0].isalpha()) and text[: m.start()][-1:].isalpha() and text[m.start() - 1].isascii() for m in _CLITIC.finditer(text))
    return found if found and _ENGLISH.search(text) else 0


def _bytes(text: str, codec: str) -> bytes | None:
    """The text in an encoding; C1 controls stand for the bytes an encoding leaves undefined. None if it does not fit."""
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        pass
    if codec in _TWO_BYTES:
        return None
    out = bytearray()
    for c in text:
        try:
            out += c.encode(codec)
        except UnicodeEncodeError:
            if 0x80 <= ord(c) <= 0x9F:
                out.append(ord(c))
            else:
                return None
    return bytes(out)


def _fitting(codec: str) -> re.Pattern:
    """Runs of the characters that a single-byte encoding holds, with some beyond ASCII among them."""
    held = "".join(c for b in range(0x80, 0x100) if (c := bytes([b]).decode(codec, "ignore") or chr(b)))
    other = re.escape(held + "".join(map(chr, range(0x80, 0xA0))))
    return re.compile(f"[\\x00-\\x7f]*[{other}](?:[\\x00-\\x7f]*[{other}])*[\\x00-\\x7f]*")


_FITTING = {c: _fitting(c) for c in WRONG if c not in _TWO_BYTES}


def _cut(text: str, codec: str) -> list[tuple[str, bytes | None]]:
    """The text in pieces, each with its bytes in ``codec``, None where it does not fit: as a whole, else stretch by stretch."""
    data = _bytes(text, codec)
    if data is not None:
        return [(text, data)]
    if codec in _TWO_BYTES:
        return []
    out, at = [], 0
    for m in _FITTING[codec].finditer(text):
        out += [(text[at : m.start()], None), (m[0], _bytes(m[0], codec))]
        at = m.end()
    return [*out, (text[at:], None)] if out else []


def _reread(cut: list[tuple[str, bytes | None]], written: str) -> str:
    """The pieces of :func:`_cut`, read in the encoding ``written`` where their bytes can be."""
    out = []
    for piece, data in cut:
        try:
            out.append(piece if data is None else data.decode(written))
        except UnicodeDecodeError:
            out.append(piece)
    return "".join(out)


_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


#: UTF-8 sequences in a row, so many and of such first bytes as proper text in a two-byte encoding hardly holds.
_UTF8_RUN = re.compile(rb"(?:[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){2,}|(?:[\xc3-\xc5\xd0\xd1][\x80-\xbf]){3,}")


def _byte(c: str, codec: str) -> bytes:
    """A character's bytes in a two-byte encoding: also C1 controls and private use stand for some; for others a byte that UTF-8 lacks."""
    try:
        return c.encode("gb18030" if codec == "gbk" and "\ue000" <= c <= "\uf8ff" else codec)
    except UnicodeEncodeError:
        return bytes([ord(c)]) if "\x80" <= c <= "\x9f" else b"\xff"


def _parts_as_utf8(run: str, codec: str) -> str:
    """A run of characters in a two-byte encoding, with the UTF-8 in their bytes decoded. Characters beside it stay; those cut by it were lost in part."""
    each = [_byte(c, codec) for c in run]
    data = b"".join(each)
    spans = [m.span() for m in _UTF8_RUN.finditer(data)]
    out, at, k, done = [], 0, 0, 0
    for c, b in zip(run, each):
        end = at + len(b)
        while k < len(spans) and spans[k][1] <= at:
            k += 1
        if k == len(spans) or spans[k][0] >= end:
            out.append(c)
        else:
            if done <= k:
                out.append(data[slice(*spans[k])].decode("utf_8", "replace"))
                done = k + 1
            if (at < spans[k][0] or end > spans[k][1]) and out[-1][-1:] != "\ufffd":
                out.append("\ufffd")
        at = end
    return "".join(out)


def _as_utf8(text: str, codec: str) -> str:
    """The runs beyond ASCII that fit ``codec``, with the UTF-8 sequences in them decoded; the rest stays."""

    def run(m: re.Match) -> str:
        data = _bytes(m[0], codec)
        if data is None and codec not in _TWO_BYTES:
            return m[0]
        try:
            if data is not None:
                return data.decode()
        except UnicodeDecodeError:
            pass
        if codec in _TWO_BYTES:
            return _parts_as_utf8(m[0], codec)
        out, at = [], 0
        for seq in _UTF8.finditer(data):
            out.append(data[at : seq.start()].decode(codec, "ignore"))
            try:
                out.append(seq[0].decode())
            except UnicodeDecodeError:
                out.append(seq[0].decode(codec, "ignore"))
            at = seq.end()
        return "".join(out) + data[at:].decode(codec, "ignore")

    return _OTHER_RUN.sub(run, text)


#: First bytes of UTF-8 sequences whose characters were set in lower case after the damage.
_LOWERED = re.compile(r"[ãâåäðñăĺđγ](?=[^\x00-\x7f])")
_ROMAN = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1254")


def _recased(text: str) -> str:
    return _LOWERED.sub(lambda m: m[0].upper(), text)


_OTHER_RUN = re.compile(r"[^\x00-\x7f]+")


def _upcased(text: str) -> str:
    """The runs of characters beyond ASCII that begin like a UTF-8 sequence, in upper case as a whole."""
    return _OTHER_RUN.sub(lambda m: "".join(c.upper() if len(c.upper()) == 1 else c for c in m[0]) if _LOWERED.match(m[0]) else m[0], text)


#: The ways to undo a change to lower case: of first bytes, or of all bytes that show as letters.
_RECASE = {"recased": _recased, "upcased": _upcased}


def moves(text: str) -> Iterator[tuple[str, str]]:
    """Every operation that applies: its name and the text it leads to."""
    for codec in WRONG:
        after = _as_utf8(text, codec)
        if after != text:
            yield f"{codec}>utf_8", after
        elif codec in _ROMAN:
            for how, recase in _RECASE.items():
                if (cased := recase(text)) != text and (after := _as_utf8(cased, codec)) != cased:
                    yield f"{codec}>{how}>utf_8", after
        if cut := _cut(text, codec):
            for written in WRITTEN:
                if written not in ("utf_8", codec) and (after := _reread(cut, written)) != text:
                    yield f"{codec}>{written}", after
    if "&" in text and (after := html.unescape(text)) != text:
        yield "unescape", after
    if (after := _without_lost(text)) != text:
        yield "lost", after


def _without_lost(text: str) -> str:
    """The text without what a lossy decoding left behind, but for such signs as are cited."""
    for mask in _MASKS:
        if mask.search(text):
            return "".join(part if i % 2 else _LOST.sub("", part) for i, part in enumerate(re.split(f"((?:{'|'.join(m.pattern for m in _MASKS)}))", text)))
    return _LOST.sub("", text)


def _price(operation: str) -> float:
    """Undoing a wrong decoding of UTF-8 is by far the commonest repair; conversions into two-byte encodings are the rarest."""
    if operation.count(">") > 1:
        return 0.2
    if operation.endswith("utf_8") or operation in ("unescape", "lost"):
        return 0.01
    return 1.2 if any(x in operation for x in _TWO_BYTES) else 0.3


#: Marks into which letters turn where a text's typography was read wrongly.
_TYPOGRAPHY = frozenset("“”‘’–—…•«»„°€™©®§¿¡")


#: The most that commoner letters make an operation cheaper: it decides between operations of equal cost.
MOST_BONUS = 0.25
#: What valid UTF-8 sequences count for at most when texts are compared: they hardly come about by chance.
MOST_PROOF = 2.0


def _toll(operation: str, before: str, after: str, model: Letters) -> float:
    """What an operation costs beyond its price for what it does to this text: little evidence, letters that become no letters, or rarer ones."""
    if operation in ("unescape", "lost"):
        return 0.0
    wrong, _, written = operation.partition(">")
    if wrong in _TWO_BYTES:
        return 1.5 if sum(c >= "\x80" for c in after) < 4 else 0.0
    if written.endswith("utf_8") or len(before) != len(after):
        return 0.0
    toll, marks, gained = 0.0, 0.0, 0.0
    cyrillic = 0
    for i, (x, y) in enumerate(zip(before, after)):
        if x == y:
            continue
        if x.isalpha():
            if not y.isalpha():
                if y in _TYPOGRAPHY:
                    marks = min(0.5, marks + 0.25)
                else:
                    toll += 1.0
                continue
            around = [(t[i - 1].lower() if i and t[i - 1].isalpha() else "", t[i + 1].lower() if i + 1 < len(t) and t[i + 1].isalpha() else "") for t in (before, after)]
            gained += model.bits(x.lower()[:1], *around[0]) - model.bits(y.lower()[:1], *around[1])
            cyrillic += script(x) == script(y) == "CYRILLIC"
    toll += min(3.0, -gained / 4) if gained < 0 else -min(MOST_BONUS, gained / 200)
    if 0 < cyrillic < 5:
        toll += 1.5
    return toll + marks


def search(text: str, vocabularies: tuple[str, ...] = VOCABULARIES, work: int = WORK, first: bool = False) -> tuple[str, float, tuple[str, ...]]:
    """The cheapest text reachable, its cost and the operations that lead to it; the text itself if none is clearly cheaper.

    States are expanded from the cheapest on, until none is left that could lead to a text clearly cheaper than the
    best one. An operation that lowers the cost too little (:data:`FALL`) leads to no further state, and a state is left
    where the best text could not fall any more by :data:`GAIN` and :data:`LEAST_FALL` after the price of the way
    there; what states are then still open after ``work`` characters is not followed. With ``first``, the first text
    that is clearly cheaper ends the search: it tells whether there is any.
    """
    start = cost(text, vocabularies)
    model = letters(vocabularies)
    best = (start, text, ())
    rank = start
    heap = [(start, 0, text, (), 0.0, start, 0.0)]
    visited = {hash(text)}
    lost = len(_LOST.findall(text))
    n = 0
    while heap and work > 0:
        _, _, at, path, paid, here, proof = heapq.heappop(heap)
        if best[0] - paid < (max(GAIN, LEAST_FALL * start) if paid >= 0.3 else GAIN):
            continue
        for name, after in moves(at):
            if (h := hash(after)) in visited:
                continue
            visited.add(h)
            work -= len(after)
            if name == "lost" and len(_LOST.findall(at)) > lost:
                continue  # only what was lost before the search began may be dropped
            there = cost(after, vocabularies, max(FALL * here, SHARE_LEFT * start))
            utf8 = name.endswith("utf_8")
            price = _price(name) if utf8 or paid < 0.3 else 2 * _price(name)  # a second wrong encoding is rarer than the first
            sound = proof + (min(MOST_PROOF, 0.25 * (len(at) - len(after))) if utf8 else 0.0)
            total = there + paid + price
            if total - sound - MOST_BONUS < rank and start - total + MOST_BONUS >= GAIN:
                total += _toll(name, at, after, model)
                if total - sound < rank and start - total >= GAIN and total <= SHARE_LEFT * start:
                    best, rank = (total, after, (*path, name)), total - sound
                    if first or (there == 0 and utf8):
                        return best[1], best[0], best[2]
            if 0 < there <= FALL * here:
                n += 1
                heapq.heappush(heap, (0.3 * there if utf8 else there, n, after, (*path, name), paid + price, there, sound))
    return best[1], best[0], best[2]


def apply(text: str, path: tuple[str, ...]) -> str | None:
    """The text after the named operations, or None where one does not apply."""
    for name in path:
        wanted = dict(moves_of(text, name))
        if name not in wanted:
            return None
        text = wanted[name]
    return text


def moves_of(text: str, name: str) -> Iterator[tuple[str, str]]:
    """The operation of that name, if it applies."""
    if name in ("unescape", "lost"):
        yield name, html.unescape(text) if name == "unescape" else _without_lost(text)
        return
    codec, *recase, written = name.split(">")
    text = _RECASE[recase[0]](text) if recase else text
    if written == "utf_8":
        yield name, _as_utf8(text, codec)
        return
    if (after := _reread(_cut(text, codec), written)) not in ("", text):
        yield name, after


def segments(text: str) -> list[str]:
    """The text cut after sentences and lines; joined, they are the text."""
    return [m[0] for m in _SEGMENT.finditer(text) if m[0]]


def examine(text: str | None, restore: bool, vocabularies: tuple[str, ...] = VOCABULARIES) -> tuple[bool, str | None, str]:
    """Whether the text holds wrongly decoded characters, the restored text, and the operations used.

    Every stretch that is not pure ASCII, or holds an entity, is a start of the search. Without ``restore``, the first
    case ends the work and the text is not rebuilt.
    """
    if not text or (text.isascii() and not _ENTITY.search(text)):
        return False, text, ""
    found, out, used = False, [], []
    known: tuple[str, ...] = ()
    for part in segments(text):
        begins = part
        if "&" in part and _ENTITY.search(part) and cost(html.unescape(part), vocabularies) > 0:
            begins = html.unescape(part)  # what is escaped and wrong at once is judged by what it shows
        before = 0.0 if begins.isascii() else cost(begins, vocabularies)
        if before >= GAIN:
            path: tuple[str, ...] = ()
            after = part
            if known and (again := apply(begins, known)) is not None and again != begins and cost(again, vocabularies) == 0:
                after, path = again, known
            else:
                after, _, path = search(begins, vocabularies, first=not restore)
            if path:
                found = True
                if not restore:
                    return True, None, ""
                kept = apply(begins, tuple(p for p in path if p != "lost")) if "lost" in path else after
                kept = after if kept is None else kept
                if cost(_without_lost(kept), vocabularies) <= max(WRITE, WRITE_SHARE * before):
                    known, part = path, kept
                    if " ".join(path) not in used:
                        used.append(" ".join(path))
        out.append(part)
    return found, "".join(out), "; ".join(used)


_ENTITY = re.compile(r"&(?:#\d{2,6}|#x[0-9A-Fa-f]{2,5}|[A-Za-z]{2,8}\d?);")


def garbled(rows: DataFrame, key: str = "doc_id", text: str = "text", restore: bool = False, vocabularies: tuple[str, ...] = VOCABULARIES) -> DataFrame:
    """The rows whose text holds wrongly decoded characters: the key; with ``restore`` also ``restored`` and ``operations``.

    restored is the cheapest text reached, stretch by stretch; what was lost stays as it is, and so does a stretch whose
    cheapest text is still implausible (``operations`` does not name its path then). Defined results: null and
    empty texts and those of ASCII without entities are no cases, nor are texts that only cite garbled sequences or use
    rare characters properly; texts are examined whole; repeated rows are judged each, equal results come out once;
    other columns are ignored; an empty table gives no rows.
    """
    kept = rows.select(key, F.col(text).alias("_text")).where(F.col("_text").rlike(r"[^\x00-\x7F]|&(?:#|[A-Za-z]{2,8}\d?;)"))
    schema = kept.select(key).schema
    if restore:
        schema = schema.add("restored", T.StringType()).add("operations", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [examine(t.as_py(), restore, vocabularies) for t in batch.column("_text")]
            at = [i for i, f in enumerate(found) if f[0]]
            arrays = [batch.column(key).take(pa.array(at, pa.int64()))]
            if restore:
                arrays += [pa.array([found[i][1] for i in at], pa.string()), pa.array([found[i][2] for i in at], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return kept.mapInArrow(run, schema).distinct()
