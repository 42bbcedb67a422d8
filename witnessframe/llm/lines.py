"""Quality rules: counts over whole texts, and a CRF that marks each line as content or boilerplate."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import crf, words

CONTENT, BOILERPLATE = 0, 1
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
LEAST_CONTENT = 0.5
WIDTH = 5
SYMBOLS = "#*$%&|<>"
CUES = (
    "license licensed licence copyright rights reserved gnu apache cookie cookies privacy terms subscribe newsletter "
    "click menu login logout signup share tweet download home sitemap contact advertisement sponsored javascript"
).split()
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".?!:;,\"')"]] = True
FEATURES = (
    "bias", "words<2", "words<4", "words<8", "words<16", "words>=16", "marked>.2", "marked>.5", "exclaimed>.3", "capitals>.5", "bars>.1", "bars>.3",
    "again>.2", "again>.5", "stops", "digits>.2", "seen_before", "cue", "cues", "few_kinds", "ends_in_mark",
)
_U = np.uint64


@functools.lru_cache(1)
def _cue_hashes() -> np.ndarray:
    text = " ".join(CUES).encode()
    return np.sort(words.hashes(words.split(np.frombuffer(text, np.uint8), np.array([0, len(text)]))))


def line_features(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Features of every line with a word, the text it belongs to, its word count, and counts per text."""
    found = words.split(data, bounds)
    n = len(bounds) - 1
    hashed, exact = words.hashes(found), words.hashes(found, lower=False)
    length = found.end - found.start
    count = np.diff(found.first)
    owner = found.text_of_word
    # A line is named by the number of line ends and text bounds before its words.
    breaks = np.sort(np.concatenate([np.flatnonzero(data == 10), bounds[:-1]]), kind="stable")
    line_of = np.searchsorted(breaks, found.start, "right")
    # A text's own start is one of the breaks, so words of different texts never share a line.
    fresh = np.ones(len(line_of), bool)
    fresh[1:] = line_of[1:] != line_of[:-1]
    at = np.flatnonzero(fresh)
    lines = len(at)
    line = np.cumsum(fresh) - 1
    text_of = owner[at]
    n_words = np.diff(np.append(at, len(line_of)))

    def share(flag: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flag.astype(np.int64), at) / n_words if lines else np.zeros(0)

    last = data[found.end - 1] if len(owner) else np.zeros(0, np.uint8)
    upto = lambda flag: np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    capital, lower, digit = upto((data >= 65) & (data <= 90)), upto((data >= 97) & (data <= 122)), upto((data >= 48) & (data <= 57))
    in_word = lambda c: c[found.end] - c[found.start]
    again = np.zeros(len(owner), bool)
    again[1:] = (hashed[1:] == hashed[:-1]) & ~fresh[1:]
    cue = np.isin(hashed, _cue_hashes())
    # Whole lines are equal if their bytes are; white space counts, so lines are hashed from end to end.
    line_start = breaks[line_of[at] - 1] if lines else np.zeros(0, np.int64)
    line_start = line_start + (data[line_start] == 10) if lines else line_start
    line_start = np.maximum(line_start, bounds[text_of]) if lines else line_start
    next_break = np.append(breaks, len(data))[line_of[at]] if lines else line_start
    line_end = np.minimum(next_break, bounds[text_of + 1]) if lines else line_start
    whole = words.hashes(words.Words(data, bounds, line_start, line_end, bounds), lower=False) if lines else np.zeros(0, _U)
    order = np.lexsort((np.arange(lines), whole, text_of))
    repeat = np.zeros(lines, bool)
    same = (whole[order][1:] == whole[order][:-1]) & (text_of[order][1:] == text_of[order][:-1])
    repeat[order[1:]] = same
    pair = np.unique(line.astype(_U) * _U(0x9E3779B97F4A7C15) ^ (hashed >> _U(20)), return_index=True)[1]
    kinds = np.bincount(line[pair], minlength=lines)
    marked, bars = share(_SYMBOL[last]), share((last == 124) & (length == 1))
    exclaimed, capitals = share(last == 33), share((in_word(capital) > 1) & (in_word(lower) == 0))
    repeats, digits, cues = share(again), share(2 * in_word(digit) > length), np.rint(share(cue) * n_words)
    final = last[np.append(at[1:], len(last)) - 1] if lines else last
    table = np.stack([
        np.ones(lines), n_words < 2, (n_words >= 2) & (n_words < 4), (n_words >= 4) & (n_words < 8), (n_words >= 8) & (n_words < 16), n_words >= 16,
        marked > 0.2, marked > 0.5, exclaimed > 0.3, capitals > 0.5, bars > 0.1, bars > 0.3, repeats > 0.2, repeats > 0.5, _STOP[final], digits > 0.2,
        repeat, cues >= 1, cues >= 2, (n_words >= 8) & (3 * kinds < n_words), _SYMBOL[final],
    ], axis=1).astype(np.float64)
    # Words inside 5-word windows that occur twice or more.
    window, place = words.full_windows(exact, found.first, WIDTH)
    text_w = owner[place]
    order = np.lexsort((window, text_w))
    equal = (window[order][1:] == window[order][:-1]) & (text_w[order][1:] == text_w[order][:-1])
    double = np.zeros(len(window), bool)
    double[order[1:]] |= equal
    double[order[:-1]] |= equal
    change = np.zeros(len(owner) + 1, np.int64)
    np.add.at(change, place[double], 1)
    np.add.at(change, place[double] + WIDTH, -1)
    covered = np.cumsum(change[:-1]) > 0
    point = upto((data & 0xC0) != 0x80)
    return {
        "features": table, "text": text_of, "line_words": n_words, "n_words": count,
        "word_chars": np.diff(upto(in_word(point))[found.first]), "n_symbols": np.diff(upto(_SYMBOL[data])[bounds]),
        "n_dup_lines": np.bincount(text_of[repeat], minlength=n), "n_repeat_words": np.diff(upto(covered)[found.first]),
    }


# A small labelled table: C content, B boilerplate, one document per block.
TABLE = """
C The old house stood at the end of a long road, and nobody had lived there for years.
C When the rain came, water ran down the walls and into the garden.
C She said that it was time to go.
B Copyright 2019 All rights reserved.

B Home | News | Sports | Weather | Contact | Login
C The council met on Tuesday to talk about the new bridge over the river.
C Several people spoke against it.
C A vote is planned for next month, after the report has been read by all members.
B Subscribe to our newsletter. Click here.

B BUY NOW!! BEST!! PRICE!! HURRY!! ONLY!! TODAY!!
B FREE!! SHIPPING!! FOR!! ALL!! ORDERS!! CLICK!! HERE!!
B LIMITED!! OFFER!! ENDS!! SOON!!

B The*** best### price%%% in&&& the$$$ whole*** town###
B order%%% today&&& and*** save$$$ more### money%%% now***
B one### two*** three$$$

B alpha | beta | gamma | delta | epsilon | zeta
B one | two | three | four | five | six | seven |
B red | green | blue. | white |

B the the the the the the the the the the the the
B and and and and and and and and and
B word word word word. word word

C In the first part of the book we learn how the village came to be.
C It rained.
C Nobody knew why the letter had come so late, or who had sent it.

C Erste Sätze können kurz sein. Danach folgt ein langer Satz, der mehr erklärt als nötig.
C Und so ging es weiter, bis der Winter kam.
B Licensed under the Apache License, Version 2.0.

C Les enfants jouent dans le jardin pendant que leur mère lit un livre près de la fenêtre.
C Puis ils rentrent.

C Los niños juegan en el jardín mientras su madre lee un libro cerca de la ventana.
C El perro duerme.
B Terms of use | Privacy | Cookies | Sitemap

C This sentence stands alone in its document, as short texts sometimes do.

C Part one
C The ship left the harbour before dawn with forty people on board.
C By noon the coast was out of sight

C the man walked to the shop and back again without a word to anyone he met
C he was tired

C It was the best of days. The sun was high, the wind was low, and the sea lay still.
B WIN!! A!! PRIZE!! TODAY!!
B more*** stuff### here%%% now&&&
C They walked home along the beach and talked about the summer.

B So*** many### marks%%% stand&&& behind$$$ the*** words### of%%% this&&& line$$$ that*** nobody### can%%% read&&& it$$$ with*** ease,### and%%% it&&& goes$$$ on.***
B and*** on### and%%% then&&& it$$$ ends.***
C A plain line follows, which says something that a reader may want to know about the place.
B one*** more### line%%% with&&& marks$$$ after*** all### of%%% its&&& words$$$ though*** it### has%%% many&&& of$$$ them### here.

B apples | pears | plums | cherries | grapes | lemons | limes | melons | berries | figs | dates | nuts | rice | corn | wheat | oats
B salt | sugar | flour | butter | milk. | Cream | eggs | yeast, | honey | tea | coffee | juice | water | wine | beer.

B THIS!! IS!! THE!! LAST!! DAY!! TO!! BUY!! ALL!! OF!! THE!! THINGS!! THAT!! YOU!! NEED!! FOR!! YOUR!! HOME.!!
B COME!! AND!! SEE!! WHAT!! WE!! HAVE!! FOR!! YOU!! IN!! THE!! SHOP!! ON!! THE!! CORNER!! OF!! THE!! STREET.

B go go go go go go go go go go go go go go stop stop stop stop stop stop stop stop stop stop stop stop

C It was late when the last guests left the house and walked down the hill, talking about what they had heard and what it could mean for them.
C Then all was quiet, and the lights went out one after another, until the hill lay dark under the stars and only the sound of the sea was left.

B Share | Tweet | Download
B Menu
B Login
C A short report follows, with the main facts and some words of thanks.
C We thank everyone who helped us to write it, and those who read early drafts.
B Copyright notice: all rights reserved, licence terms apply.
"""


@functools.lru_cache(1)
def model() -> crf.Chain:
    blocks = [[line.split(" ", 1) for line in block.splitlines()] for block in TABLE.strip().split("\n\n")]
    raw = ["\n".join(text for _, text in block).encode() for block in blocks]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    found = line_features(np.frombuffer(b"".join(raw), np.uint8), bounds)
    cut = np.searchsorted(found["text"], np.arange(1, len(blocks)))
    labels = [np.array([BOILERPLATE if tag == "B" else CONTENT for tag, _ in block]) for block in blocks]
    return crf.train(np.split(found["features"], cut), labels, 2, ridge=0.002)


def judge(docs: DataFrame) -> DataFrame:
    """Counts and verdict for every text of ``docs(doc_id, text, ...)``.

    -> ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    content_share``. The lines of a text are one sequence; Viterbi marks each line with a word
    as content or boilerplate, and a text is kept if it did not fail on its counts (fewer than 10
    words, or over a fifth of them in repeated 5-word windows) and content lines hold at least half
    of its words. The chain is trained on the small table in this module, on the driver. A null or blank text has no words and fails;
    repeated rows give equal rows; extra columns are ignored.
    """
    chain = model()

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, bounds in words.slices(batch.column(1)):
                f = line_features(data, bounds)
                n = stop - row
                first = np.searchsorted(f["text"], np.arange(n + 1))
                label = crf.viterbi(f["features"] @ chain.weights, first, chain)
                content = np.bincount(f["text"], f["line_words"] * (label == CONTENT), n)
                failed = (f["n_words"] < LEAST_WORDS) | (100 * f["n_repeat_words"] > MOST_REPEATED_PERCENT * f["n_words"])
                part = content / np.maximum(f["n_words"], 1)
                counts = [pa.array(f[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), *counts, pa.array(failed), pa.array(~failed & (part >= LEAST_CONTENT)), pa.array(part)],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"],
                )

    return words.small_batches(docs).select("doc_id", "text").mapInArrow(
        verdicts,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double",
    )
