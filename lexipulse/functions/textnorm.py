"""Text normalisation, tokens and n-grams as column expressions.

HTML entities and NFKC need Python: an Arrow function gets the texts with an ampersand or a character beyond
ASCII, and null for all others, so plain rows cost a null each and the table is scanned once.
"""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from xxhash import xxh3_64_intdigest

# Single characters and what replaces them; those without a partner vanish
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2212\u2015\u00ad"
SUBSCRIPTS, SUPERSCRIPTS, DIGITS = "₀₁₂₃₄₅₆₇₈₉", "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"
QUOTES, PLAIN_QUOTES = "’‘“”", "''\"\""
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl"}
SPACE, VANISHING = "\u00a0", "\u200b\ufeff"
# LaTeX symbols in the order of their replacement
LATEX_SYMBOLS = {r"\beta": "beta", r"\alpha": "alpha", r"\gamma": "gamma", r"\mu": "u", r"\AA": "A", r"\%": "%", r"\&": "&", r"\_": "_", r"\,": " ", r"\;": " ", r"\!": ""}
# LaTeX commands whose argument stays
LATEX_COMMANDS = ("mathrm", "mathbf", "textrm", "text", "rm", "it", "emph", "textbf", "textit", "ce", "chem")
# Words that start and end no n-gram
STOP_WORDS = frozenset("""
a an the and or of in on at to for with by from as is are was were be been being this that these those it its into
via using used use based novel new approach method methods paper propose proposed present presented presents study
results result show shows shown we our can which than then when where while also both between over under about
such more most high low large small first two three one due each per non only well very further however moreover
between within without through during after before above below across among against several various different
achieve achieved achieves obtain obtained provides provide demonstrate demonstrated demonstrates investigate
investigated compared comparison respectively performance proposed-based total value values number time
significantly effect effects analysis model models design designs device devices technique techniques data
system systems application applications process processes structure structures material materials layer layers
work works et al fig table
""".split())

# What a token is, and which tokens are numbers
TOKEN = r"[a-z0-9][a-z0-9\-.]*[a-z0-9]|[a-z0-9]"
NUMERIC = r"^[0-9.\-]+$"
BLANK = r"(?U)[\s\x1c-\x1f]+"


@F.arrow_udf(StringType())
def unescaped(texts: pa.Array) -> pa.Array:
    """HTML entities resolved, then NFKC; null stays null.

    Python's normalise returns at once where nothing is to do; Arrow's own kernel leaves accented letters in two parts.
    """
    return pa.array((t if t is None else unicodedata.normalize("NFKC", html.unescape(t)) for t in texts.to_pylist()), texts.type)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]{1,40}>", " ")


def latex_unwrap(text: Column) -> Column:
    """Symbols, commands (two levels), sub- and superscripts, dollars and braces."""
    out = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), LATEX_SYMBOLS.items(), text)
    command = rf"\\(?:{'|'.join(LATEX_COMMANDS)})(?U:\s*)\{{([^{{}}]*)\}}"
    for _ in range(2):
        out = F.regexp_replace(out, command, "$1")
    out = F.regexp_replace(out, r"_\{?(\p{Nd}+(?:\.\p{Nd}+)?)\}?", "$1")
    out = F.regexp_replace(out, r"\^\{?((?U:[^{}\s]){1,6})\}?", " $1 ")
    return F.regexp_replace(out, r"\$+|[{}]", "")


def plain_characters(text: Column) -> Column:
    """The character table: dashes, digits, spaces, quotes, ligatures."""
    source = DASHES + SUBSCRIPTS + SUPERSCRIPTS + SPACE + QUOTES + VANISHING
    out = F.translate(text, source, "-" * len(DASHES) + DIGITS + DIGITS + " " + PLAIN_QUOTES)
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), LIGATURES.items(), out)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANK, " "))


def normalise_ascii(text: Column) -> Column:
    """The chain without Python: right for texts of ASCII characters without entities."""
    return squeezed(latex_unwrap(strip_tags(plain_characters(F.coalesce(text, F.lit(""))))))


def normalise(text: Column) -> Column:
    """Any text on one line in plain characters; null gives the empty text."""
    odd = text.rlike(r"[^\x00-\x7F]|&")
    return normalise_ascii(F.coalesce(unescaped(F.when(odd, text)), text))


def tokens(text: Column) -> Column:
    """Lower-case tokens: letters and digits, hyphens and dots inside."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def numeric(token: Column) -> Column:
    return token.rlike(NUMERIC)


_EDGE = np.zeros(256, bool)
_EDGE[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True
_INSIDE = _EDGE.copy()
_INSIDE[[ord("-"), ord(".")]] = True


def cut(low: pa.Array) -> pa.ListArray:
    """The tokens of texts in lower case, as ``tokens`` has them; null for null.

    A token is a run of the characters that may stand inside one, without the hyphens and dots at its ends.
    """
    filled = pc.fill_null(low.cast(pa.string()), "")
    edge = np.frombuffer(filled.buffers()[1], np.int32, len(filled) + 1, filled.offset * 4) if len(filled) else np.zeros(1, np.int32)
    data = np.frombuffer(filled.buffers()[2] or b"", np.uint8)[edge[0] : edge[-1]]
    edge = edge - edge[0]
    inside = _INSIDE[data]
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1]
    tail[:-1] &= ~inside[1:]
    for ends, at in ((head, edge[edge < len(data)]), (tail, edge[edge > 0] - 1)):  # texts lie side by side
        ends[at] = inside[at]
    start, end = np.flatnonzero(head), np.flatnonzero(tail)
    if not (_EDGE[data[start]].all() and _EDGE[data[end]].all()):
        solid = np.flatnonzero(_EDGE[data])
        a, b = np.searchsorted(solid, start), np.searchsorted(solid, end, "right") - 1
        a, b = a[there := a <= b], b[there]
        start, end = solid[a], solid[b]
    turn = np.zeros(len(data) + 1, np.int8)
    turn[start] = 1
    turn[end + 1] -= 1
    words = data[np.cumsum(turn[:-1], dtype=np.int8).view(bool)]
    offsets = np.concatenate([[0], np.cumsum(end - start + 1)]).astype(np.int32)
    flat = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(words.tobytes()))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(start, edge), pa.int32()), flat, mask=low.is_null())


def _tagged(words: pa.Array, stop: frozenset[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word: does it stand alone, start, end, or stand inside an n-gram."""
    inside = ~np.asarray(pc.match_substring_regex(words, NUMERIC), bool)
    edge = inside & ~np.asarray(pc.is_in(words, pa.array(sorted(stop), words.type)), bool)
    size = np.asarray(pc.utf8_length(words), np.int64)
    return edge & (size >= 4), edge & (size >= 3), edge & (size >= 2), inside


#: Tokens whose n-grams are found at once: some 300 bytes each while they are.
TOKENS_AT_ONCE = 1 << 17


def runs(size: np.ndarray, most: int):
    """Ranges of consecutive items that sum up to ``most`` at most, or of one item."""
    total = np.cumsum(size)
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def token_runs(toks: pa.ListArray, most: int = TOKENS_AT_ONCE):
    """Ranges of consecutive lists of about ``most`` tokens."""
    yield from runs(np.asarray(pc.fill_null(pc.list_value_length(toks), 0), np.int64), most)


@dataclass
class Grams:
    """The distinct n-grams of a batch of texts, by text, place and length: codes of their words, -1 behind the last."""

    owner: np.ndarray
    codes: np.ndarray
    words: pa.Array
    texts: int

    def joined(self, kept: np.ndarray | None = None) -> pa.Array:
        """The n-grams, or the ``kept`` ones, as strings."""
        codes = self.codes if kept is None else self.codes[kept]
        size = (codes >= 0).sum(1)
        parts, at = [], []
        for n in range(1, codes.shape[1] + 1):
            rows = np.flatnonzero(size == n)
            each = [self.words.take(pa.array(codes[rows, k])) for k in range(n)]
            parts.append(pc.binary_join_element_wise(*each, " ") if n > 1 else each[0])
            at.append(rows)
        order = np.empty(len(codes), np.int64)
        order[np.concatenate(at)] = np.arange(len(codes))
        return pa.concat_arrays(parts).take(pa.array(order))

    def hashes(self) -> np.ndarray:
        """A 64-bit number of each n-gram, the same in every batch."""
        word = np.fromiter(map(xxh3_64_intdigest, self.words.cast(pa.binary()).to_pylist()), np.uint64, len(self.words))
        out = np.full(len(self.codes), 0x9E3779B97F4A7C15, np.uint64)
        for code in np.ascontiguousarray(self.codes.T) if len(word) else ():
            out = np.where(code >= 0, mixed(out ^ word[code]), out)
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, spread over all their bits."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def grams_of(toks: pa.ListArray, longest: int, stop: frozenset[str]) -> Grams:
    """The distinct n-grams of each list of tokens. Each distinct token is looked at once."""
    size = np.asarray(pc.fill_null(pc.list_value_length(toks), 0), np.int64)
    flat = toks.flatten().dictionary_encode()
    code, words = np.asarray(flat.indices, np.int64), flat.dictionary
    alone, first, last, inside = _tagged(words, stop)
    doc = np.repeat(np.arange(len(size)), size)
    place, owner, codes = [], [], []
    for n in range(1, longest + 1):
        start = np.arange(max(0, len(code) - n + 1))
        ok = doc[start] == doc[start + n - 1]
        ok &= alone[code[start]] if n == 1 else first[code[start]] & last[code[start + n - 1]]
        for k in range(1, n - 1):
            ok &= inside[code[start + k]]
        start = start[ok]
        key, bound = doc[start], len(size)
        for k in range(n):  # equal keys: the same document and words so far
            if bound * len(words) >= 1 << 63:
                key, bound = np.unique(key, return_inverse=True)[1], len(start)
            key, bound = key * len(words) + code[start + k], bound * len(words)
        start = start[~pd.Series(key).duplicated().to_numpy()]
        place.append(start * longest + n - 1)
        owner.append(doc[start])
        codes.append(np.stack([code[start + k] if k < n else np.full(len(start), -1) for k in range(longest)], axis=1))
    at = np.full(len(code) * longest, -1)
    at[np.concatenate(place)] = np.arange(sum(map(len, place)))
    order = at[at >= 0]
    return Grams(np.concatenate(owner)[order], np.concatenate(codes)[order], words, len(size))


def token_ngrams(toks: pa.ListArray, longest: int, stop: frozenset[str]) -> pa.ListArray:
    """The distinct n-grams of each list of tokens, by place and length."""
    parts = [_token_ngrams(toks.slice(a, b - a), longest, stop) for a, b in token_runs(toks)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))


def _token_ngrams(toks: pa.ListArray, longest: int, stop: frozenset[str]) -> pa.ListArray:
    g = grams_of(toks, longest, stop)
    edge = np.r_[0, np.cumsum(np.bincount(g.owner, minlength=g.texts))]
    return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), g.joined(), mask=toks.is_null())


def ngrams(text: Column, longest: int = 3, stop: frozenset[str] = STOP_WORDS) -> Column:
    """The distinct n-grams of a text, one to ``longest`` tokens; null for null.

    The first token has three characters or more (four if alone) and the last two, neither is a stop word, and no token
    is a number; stop words may stand inside. Tokens are cut by the JVM; an Arrow function on whole batches joins them,
    as lambdas over arrays are interpreted for every token.
    """

    @F.arrow_udf("array<string>")
    def joined(toks: pa.Array) -> pa.Array:
        return token_ngrams(toks, longest, stop)

    return joined(tokens(text))
