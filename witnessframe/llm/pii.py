"""Personal data: exact base patterns, and a linear-chain CRF over word shapes that adds spans."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import crf, words

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "id")
LABELS = ("O", *(f"{place}-{kind}" for kind in ("card", "phone", *ADDED) for place in "BI"))
REACH = 3  # words on either side of one with a digit that the chain sees
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can begin only where a run of digits does, which keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
CUES = {
    "secret": "token secret key apikey api_key password passwd bearer credential".split(),
    "phone": "phone tel telephone call mobile fax cell dial".split(),
    "card": "card visa mastercard amex credit debit".split(),
    "id": "ssn iban passport social security account tax".split(),
    "plain": "version page section chapter license figure table year since in rfc".split(),
}


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 if place % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain; no part of the text is walked over twice."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by kind as listed and then start."""
    out = [("email", *span) for span in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


# ---- word shapes -------------------------------------------------------------------------

_DIGITS = (1, 2, 3, 4, 5, 8, 13, 16, 20)
_SIGNS = "+-().=:/\"'@_"
_SHAPE = ["bias", *(f"digits<{n}" for n in _DIGITS), "many_digits", *(f"has{c}" for c in _SIGNS),
          "lower", "upper", "letters", "hex", "long", "very_long", "mixed", *(f"cue_{k}" for k in CUES)]
_AT = {name: i for i, name in enumerate(_SHAPE)}
_WIDTH = 3 * len(_SHAPE)  # of the word, the one before and the one after
_EDGE = re.compile(r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$")
_HEX = re.compile(r"[0-9A-Fa-f]+")
_CUE = {word: kind for kind, listed in CUES.items() for word in listed}


def shape(word: str) -> np.ndarray:
    """0/1 features of one word: how many digits, which signs, what letters, how long, which cue."""
    out = np.zeros(len(_SHAPE))
    core = _EDGE.sub("", word)
    digits = sum("0" <= c <= "9" for c in core)
    names = ["bias", next((f"digits<{n}" for n in _DIGITS if digits < n), "many_digits")]
    names += [f"has{c}" for c in _SIGNS if c in word]
    letters = [c for c in core if c.isalpha()]
    if letters:
        names += ["letters"] + ["lower"] * all(c.islower() for c in letters) + ["upper"] * all(c.isupper() for c in letters)
        names += ["mixed"] * (digits > 1)
    names += ["hex"] * bool(_HEX.fullmatch(core) and digits) + ["long"] * (len(core) >= 16) + ["very_long"] * (len(core) >= 28)
    cue = _CUE.get(core.lower())
    if cue:
        names.append(f"cue_{cue}")
    for name in names:
        out[_AT[name]] = 1
    return out


def sequence_features(shapes: np.ndarray) -> np.ndarray:
    """Own shape, that of the word before and that of the word after."""
    none = np.zeros((1, shapes.shape[1]))
    return np.hstack([shapes, np.vstack([none, shapes[:-1]]), np.vstack([shapes[1:], none])])


# A small labelled table. [kind ...] marks a span; # stands for a digit, ~ for a hex digit, each drawn anew per copy.
TABLE = """
and then [card ################] was sent
we had [card ################] [card ################] on file
pay with [card #### #### #### ####] before noon
card number [card ####-####-####-####] and the name
the card [card ################], and more
visa [card ################] expires ##/##
tomorrow at [phone (###) ###-####] or later
call [phone (###) ###-####] for help
call me on [phone ###-###-####] in the morning
phone [phone ### ### ####] or write
tel [phone ###.###.####] fax [phone ###.###.####]
his mobile [phone 0### #######] was off
on it [phone +# (###) ###-####] with the
of [phone +## ### #######] and on
it was token = [secret ~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~] in the file
of the token = "[secret ~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~]" and then
secret: [secret ~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~] is set
api_key = '[secret ~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~]' was found
password = [secret a#b#cd##Xy#zQ##k] there
bearer [secret ~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~] again
"[secret ~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~]" was left there
ssn [id ###-##-####] is known
her number is [id ###-##-####] and she
iban [id GB##ABCD##############] please
account [id DE####################] at the bank
under version # of the license
under the Apache License, Version #.#.
licensed under CC BY-NC #.#.
on page ### of the book
in the year #### and since ####
at ##:## on ##/##/#### we met
it cost $##.## and weighed # kg
there were #,###,### people in ####
chapter # section #.#.# figure ##
see rfc #### and table ##
room ### on floor ##
they sold #### of ##### units
between #### and #### it was ##
order ######## was shipped
item ###### and ###### are here
build ############ passed
id ########### in row ##
mail to name##@mail#.example.com now
from ###.##.###.## to the next
the quick mail7 and a4 b2 words
no number in this line at all
a token of the past and a key of the door
"""


def _table(copies: int = 6) -> tuple[list[np.ndarray], list[np.ndarray]]:
    draw = np.random.default_rng(3)
    features, labels = [], []
    for line in TABLE.strip().splitlines():
        for _ in range(copies):
            text = re.sub("[#~]", lambda m: draw.choice(list("0123456789" if m[0] == "#" else "0123456789abcdef")), line)
            if draw.random() < 0.2:
                text = text.upper().replace("[CARD", "[card").replace("[PHONE", "[phone").replace("[SECRET", "[secret").replace("[ID", "[id")
            tokens, tags, kind = [], [], ""
            for token in text.split(" "):
                opened = re.search(r"\[(card|phone|secret|id)$", token)
                if opened:
                    kind, place = opened[1], "B"
                    continue
                closes = "]" in token
                if token:
                    tokens.append(token.replace("]", ""))
                    tags.append(LABELS.index(f"{place}-{kind}") if kind else 0)
                    place = "I"
                if closes:
                    kind = ""
            features.append(sequence_features(np.array([shape(t) for t in tokens])))
            labels.append(np.array(tags))
    return features, labels


@functools.lru_cache(1)
def model() -> crf.Chain:
    return crf.train(*_table(), len(LABELS))


def _valid(kind: str, found: str) -> bool:
    digits = _NOT_DIGIT.sub("", found)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "secret":
        return len(found) >= 16 and bool(digits) and len(digits) < len(found)
    return 8 <= len(digits)


def added_spans(texts: list[tuple[str, list[tuple[str, int, int]]]], chain: crf.Chain) -> list[list[tuple[str, int, int]]]:
    """Spans that the chain finds beside the base spans of each text.

    A word without a digit that is more than ``REACH`` words from any with one has nothing but
    plain features around it and lies outside every span, so only the runs of the other words
    are decoded, those of all texts in one batch.
    """
    runs, rows, shapes = [], [], {}
    for n, (text, _) in enumerate(texts):
        found = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
        digit = np.array([bool(re.search("[0-9]", m[0])) for m in found], bool)
        near = np.convolve(digit, np.ones(2 * REACH + 1), "full")[REACH : REACH + len(digit)] > 0 if len(digit) else digit
        place = np.flatnonzero(near)
        for run in np.split(place, np.flatnonzero(np.diff(place) > 1) + 1):
            if len(run):
                tokens = [found[i] for i in run]
                for token in tokens:
                    if token[0] not in shapes:
                        shapes[token[0]] = shape(token[0])
                runs.append((n, tokens))
                rows.append(sequence_features(np.array([shapes[t[0]] for t in tokens])))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not runs:
        return out
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    best = crf.viterbi(np.concatenate(rows) @ chain.weights, offsets, chain)
    for (n, tokens), low in zip(runs, offsets):
        text, base = texts[n]
        tags = [LABELS[best[low + i]] for i in range(len(tokens))]
        i = 0
        while i < len(tags):
            if tags[i] == "O":
                i += 1
                continue
            kind, j = tags[i][2:], i + 1
            while j < len(tags) and tags[j] == f"I-{kind}":
                j += 1
            start, end = tokens[i].start(), tokens[j - 1].end()
            edge = "0123456789(+" if kind == "phone" else "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
            while start < end and text[start] not in edge:
                start += 1
            while end > start and text[end - 1] not in edge.rstrip("(+"):
                end -= 1
            if _valid(kind, text[start:end]) and all(end <= a or start >= b for _, a, b in base):
                out[n].append((kind, start, end))
            i = j
    return out


def find(docs: DataFrame) -> DataFrame:
    """Personal data in every text of ``docs(doc_id, text, ...)``.

    -> ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` with spans as
    ``kind:start:end`` in code points: the base patterns first, by kind and start, whose counts
    and digest stand alone; then, by kind and start among them, cards, phones, secrets and
    identity numbers that the chain adds where no base span lies. The chain is trained on the
    small table in this module, on the driver. A null text is empty; repeated rows give equal rows; extra columns are ignored.
    """
    chain = model()
    rank = {kind: n for n, kind in enumerate((*BASE, *ADDED))}

    def written(spans: list[tuple[str, int, int]]) -> str:
        return ",".join(f"{kind}:{start}:{end}" for kind, start, end in sorted(spans, key=lambda s: (rank[s[0]], s[1], s[2])))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for row, stop, data, bounds in words.slices(batch.column(1)):
                marked = np.concatenate([[0], np.cumsum((data == 64) | ((data >= 48) & (data <= 57)))])[bounds]
                some = np.flatnonzero(np.diff(marked))
                texts = []
                for i in some:
                    text = data[bounds[i] : bounds[i + 1]].tobytes().decode()
                    texts.append((text, base_spans(text)))
                counts = np.zeros((stop - row, len(BASE)), np.int64)
                digest, joined = [nothing] * (stop - row), [""] * (stop - row)
                for i, (_, base), more in zip(some, texts, added_spans(texts, chain)):
                    counts[i] = [sum(kind == k for k, _, _ in base) for kind in BASE]
                    digest[i] = hashlib.sha256(written(base).encode()).hexdigest()
                    joined[i] = written(base + more)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, stop - row), *(pa.array(counts[:, k]) for k in range(len(BASE))), pa.array(digest, pa.string()), pa.array(joined, pa.string())],
                    ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
                )

    return words.small_batches(docs).select("doc_id", "text").mapInArrow(spans, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
