"""How likely letters beyond ASCII stand beside each other: a model trained on the pieces of public vocabularies.

The pieces are what merging by frequency left of texts in some fifty languages, so they hold the neighbours that each
letter has in real words. Counted are, for every letter beyond ASCII, the letter before it (or the start of a word)
and the one after it, a piece weighing less the later it was merged. Nothing here names a language.
"""

from __future__ import annotations

import base64
import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

#: Where the vocabularies lie on every node; parameters of every operator that uses the model.
VOCABULARIES = ("/opt/tokenizers/byte_bpe_multi_50k.tiktoken", "/opt/tokenizers/piece_bpe_32k.model")
#: The rank at which a piece weighs half.
HALF_RANK = 3000
#: Surprise in bits that a neighbour may have at no cost, that adds one to the cost, and that counts at most.
FREE_BITS, UNIT_BITS, MOST_BITS = 7.0, 4.0, 11.0
#: A letter seen so often (in weighted pieces) is trusted half.
HALF_SEEN = 2.0


def pieces(path: str) -> Iterator[tuple[str, int]]:
    """The pieces of a vocabulary that are texts, a leading blank where a word begins, with their ranks."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(model.vocab_size()):
            if not model.is_byte(i) and not model.is_control(i) and not model.is_unknown(i):
                yield model.id_to_piece(i).replace("▁", " "), i
        return
    with open(path, "rb") as f:
        for line in f:
            text, rank = line.split()
            try:
                yield base64.b64decode(text).decode(), int(rank)
            except UnicodeDecodeError:
                continue


@lru_cache(100_000)
def script(c: str) -> str:
    """The script of a letter, from its Unicode name: LATIN, CYRILLIC, HANGUL, KANA, CJK, ..."""
    name = unicodedata.name(c, "")
    first = name.partition(" ")[0].partition("-")[0]
    if first in ("HIRAGANA", "KATAKANA", "HALFWIDTH", "IDEOGRAPHIC"):
        return "KANA"
    return {"FULLWIDTH": "LATIN", "FEMININE": "LATIN", "MASCULINE": "LATIN", "MICRO": "LATIN", "MODIFIER": ""}.get(first, first)


# The rows (first bytes) of the national standards' first levels.
_LEVELS = (("euc_jp", 0xB0, 0xCF), ("gb2312", 0xB0, 0xD7), ("big5", 0xA4, 0xC6), ("euc_kr", 0xB0, 0xC8))


def _rows(c: str) -> Iterator[tuple[int, int, int]]:
    if ord(c) < 0x3400:
        return
    for codec, low, high in _LEVELS:
        try:
            yield c.encode(codec)[0], low, high
        except UnicodeEncodeError:
            continue


#: The letters beside A to Z of languages in Latin script, each alphabet with the accents its spelling uses.
ALPHABETS = (
    "äöüß", "àâæçéèêëîïôœùûüÿ", "áéíóúñü", "áâãàçéêíóôõúü", "ąćęłńóśźż", "çğıöşüâîû", "àèéìíîòóùú", "éëïóöüáíú", "åäöé", "åæøéòôóêà",
    "áðéíóúýþæö", "áðíóúýæø", "äöåšž", "äöõüšž", "āčēģīķļņšūž", "ąčęėįšųūž", "áčďéěíňóřšťúůýž", "áäčďéíĺľňóôŕšťúýž", "áéíóöőúüű",
    "čćđšž", "ăâîșțşţ", "çëâî", "àçèéíïòóúü", "áéíóúàèìòù", "âêîôûŵŷáéïäëö", "ċġħżàèìòù", "çəğıöşü", "êîûçş", "ĉĝĥĵŝŭ",
    "àáâãèéêìíòóôõùúýăđĩũơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ",
)
_ALPHABETS = [frozenset(a) for a in ALPHABETS]
_LISTED = frozenset().union(*_ALPHABETS)


@lru_cache(50_000)
def of_one_language(seen: frozenset[str]) -> bool:
    """Whether one alphabet holds all these letters (lower case); letters that no alphabet lists are left out."""
    listed = seen & _LISTED
    return not listed or any(listed <= a for a in _ALPHABETS)


class Letters:
    """The trained model: what neighbours of a letter cost."""

    def __init__(self, vocabularies: tuple[str, ...] = VOCABULARIES) -> None:
        before: dict[str, Counter] = defaultdict(Counter)
        after: dict[str, Counter] = defaultdict(Counter)
        for path in vocabularies:
            for text, rank in pieces(path):
                if text.isascii():
                    continue
                weight = HALF_RANK / (HALF_RANK + rank)
                text = text.lower()
                for a, b in zip(text, text[1:]):
                    if not b.isascii() and b.isalpha() and (a == " " or a.isalpha()):
                        before[b][a] += weight
                    if not a.isascii() and a.isalpha() and b.isalpha():
                        after[a][b] += weight
        self.before, self.after = dict(before), dict(after)
        self.known = frozenset(before) | frozenset(after)
        self.scripts = frozenset(map(script, self.known))
        self.seen = {c: before[c].total() + after[c].total() for c in self.known}
        self.all_seen = sum(self.seen.values())

    @staticmethod
    def _surprise(counts: Counter | None, x: str) -> float:
        if not counts:
            return 9.0
        return -math.log2((counts[x] + 0.02) / (counts.total() + 1.0))

    @lru_cache(200_000)  # noqa: B019 - one model lives as long as its process
    def neighbour(self, c: str, x: str, follows: bool) -> float:
        """What it costs that the letter ``x`` (or a word's start, a blank) stands after (else before) the letter ``c``; both in lower case."""
        bits = self._surprise((self.after if follows else self.before).get(c), x)
        seen = self.seen.get(c, 0.0)
        return max(0.0, min(bits, MOST_BITS) - FREE_BITS) / UNIT_BITS * seen / (seen + HALF_SEEN)

    @lru_cache(200_000)  # noqa: B019
    def bits(self, c: str, before: str, after: str) -> float:
        """The information in a letter (lower case) and the letters beside it ("" where none is), in bits."""
        out = -math.log2((self.seen.get(c, 0.0) + 0.02) / self.all_seen)
        if before:
            out += min(self._surprise(self.before.get(c), before), MOST_BITS)
        if after:
            out += min(self._surprise(self.after.get(c), after), MOST_BITS)
        return out

    @lru_cache(100_000)  # noqa: B019
    def strange(self, c: str) -> bool:
        """Whether a letter occurs in no vocabulary and no alphabet although others of its script do. Of ideographs and syllables those are common that a national standard holds in its first level."""
        if c in self.known or c in _LISTED or script(c) not in self.scripts or unicodedata.normalize("NFKC", c).isascii():
            return False
        return not any(low <= row <= high for row, low, high in _rows(c))


@lru_cache(2)
def letters(vocabularies: tuple[str, ...] = VOCABULARIES) -> Letters:
    return Letters(vocabularies)
