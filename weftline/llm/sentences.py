"""Sentences of a text in normal form, and their hashed n-grams, for the content classifier.

The normal form undoes common disguises: compatibility forms, look-alike letters of other scripts,
digits and signs in place of letters inside words, letters set apart by blanks or dots, letters
repeated three times or more; numbers become 0. Sentences end at sentence marks, line ends, commas
and emoji, so that a remark stands apart from what it is joined to; long ones are cut into overlapping windows.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

from weftline.llm.shingles import mix

# Letters of other scripts that look like Latin ones, and signs used for letters.
LOOK_ALIKE = str.maketrans({
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
})
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"})

_LOOK = re.compile("[" + "".join(map(chr, LOOK_ALIKE)) + "]")
_INVISIBLE = re.compile("[­​-‏⁠﻿‪-‮]")
_APART = re.compile(r"(?<![a-z0-9])(?:[a-z@$!0-9*][ .\-_]){2,}[a-z@$!0-9*](?![a-z0-9])")
_MARKED = re.compile(r"(?<![a-z0-9@$!|*.,])(?=[a-z0-9@$!|]*[a-z])(?=[a-z]*[0-9@$!|])[a-z0-9@$!|]+(?=[^a-z0-9@$|]|$)")
_NUMBER = re.compile(r"[$€£]?\d[\d.,:%]*")
_LONG = re.compile(r"([a-z])\1{2,}")
_MENTION = re.compile(r"(?<![a-z0-9])@(?=[a-z0-9_\-]*[0-9_\-])[a-z0-9_\-]+")
_END = re.compile("[.?!。！？…;；,，、\\n\\r\\u2028\\u2029\\u0085]+|[\U0001f000-\U0001faff☀-➿]+|(?<= )[:;]-?[()dp](?= |$)|[-=_~*|#]{3,}")


def _latin(m: re.Match) -> str:
    return LOOK_ALIKE[ord(m.group())]


def _letters(m: re.Match) -> str:
    return re.sub(r"[ .\-_]", "", m.group())


def _signs(m: re.Match) -> str:
    w = m.group()
    tail = len(w) - len(w.rstrip("!"))
    body = w[: len(w) - tail]
    if sum(c.isdigit() for c in body) > len(body) // 2 or not body or body[0].isdigit() and body[-1].isdigit():
        return w
    return body.translate(SIGNS) + "!" * tail


def sentences(text: str | None) -> list[str]:
    """Normal forms of the sentences of the whole text (none for a null or blank text)."""
    if not text:
        return []
    x = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text).casefold())
    x = _LOOK.sub(_latin, x)
    x = _APART.sub(_letters, _MENTION.sub("@", x))
    x = _MARKED.sub(_signs, x)
    x = _LONG.sub(r"\1", x)
    x = _NUMBER.sub("0", x)
    return [w for part in _END.split(x) if (s := part.split()) for w in _windows(s)]


def _windows(words: list[str], size: int = 8, chars: int = 16) -> list[str]:
    """A sentence as it is, or overlapping windows of one that is long (missing marks run
    sentences together), so that no part of it is diluted by the rest."""
    if len(words) > size:
        step = size // 2
        return [w for i in range(0, len(words) - step, step) for w in _windows(words[i : i + size], size, chars)]
    s = " ".join(words)
    if len(words) <= 2 and len(s) > chars + chars // 2:  # scripts without blanks
        step = chars // 2
        return [s[i : i + chars] for i in range(0, len(s) - step, step)]
    return [s]


_VOWEL = np.zeros(0x110000, bool)
_VOWEL[[ord(c) for c in "aeiou*"]] = True
_WORD = np.zeros(0x110000, bool)
_WORD[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz*'0"]] = True
_WORD[0xC0:0x250] = True
_U = np.uint64
_P = _U(0xD1342543DE82EF95)


def features(sents: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, indices): hashed n-grams of each sentence: words and word pairs and triples, the
    same of words without vowels, and runs of 2 to 5 characters."""
    points = np.frombuffer("".join("\n" + s + "\n" for s in sents).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.array([len(s) + 2 for s in sents])
    owner = np.repeat(np.arange(len(sents)), lens)
    code = mix(points.astype(np.uint64) + _U(1))
    idx, own = [], []

    def add(h: np.ndarray, o: np.ndarray, ok: np.ndarray, salt: int) -> None:
        idx.append((mix(h[ok] + _U(salt * 0x9E3779B97F4A7C15 % (1 << 64))) >> _U(64 - bits)).astype(np.int32))
        own.append(o[ok])

    h = code.copy()
    for n in range(2, 6):
        h = mix(h[:-1] * _P + code[n - 1 :])
        o = owner[: len(h)]
        ok = o == owner[n - 1 :]
        if n == 2:
            ok &= points[: len(h)] > 0x2E7F  # pairs only of scripts that write words in few characters
        add(h, o, ok, n)
    word = _WORD[points]
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(s):
        run = np.cumsum(edge[:-1] == 1)  # number of the word each character is in, from 1
        for salt, use in ((100, word), (200, word & ~_VOWEL[points])):
            p = np.flatnonzero(use)
            # order inside the word matters: characters are weighed by their place among those used
            place = np.cumsum(use)[p] - np.cumsum(use)[s][run[p] - 1] + use[s][run[p] - 1]
            w = np.zeros(len(s) + 1, np.uint64)
            np.add.at(w, run[p], mix(code[p] + place.astype(np.uint64) * _P))
            w = mix(w[1:])
            o = owner[s]
            h = w
            for n in range(1, 4):
                if n > 1:
                    h = mix(h[: len(w) - n + 1] * _P + w[n - 1 :]) if len(w) >= n else h[:0]
                add(h, o[: len(h)], o[: len(h)] == o[n - 1 :] if len(h) else np.zeros(0, bool), salt + n)
    index, owners = np.concatenate(idx), np.concatenate(own)
    order = np.argsort(owners, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(sents)))])
    return offsets, index[order]
