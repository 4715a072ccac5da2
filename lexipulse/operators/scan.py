"""All plain synonyms of a taxonomy in one scan of a text, whatever their number.

Every match of a plain synonym that begins with a letter or digit begins at a token, a maximal run of ASCII letters and
digits. So an Arrow function cuts a batch's texts into tokens, looks each distinct token up once, and finds for each
concept the synonyms that the token is in whole, and those whose first part it is. Concepts that meet only whole tokens in
a text are counted on arrays. Where a first part turns up, the concept's pattern is tried at those tokens alone, from
left to right, as a search over the text would: the leftmost match counts, of several the first of the list, and the
search goes on behind it.

Two kinds of texts are searched in full by the concept's pattern: those with a character that some synonym without a
leading letter or digit begins with, and those with one of the four characters that equal an ASCII letter in another case.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.textnorm import runs
from ..taxonomy import END, GAP, START, core, is_phrase, is_raw

#: What an extraction returns for a text.
FOUND = "struct<inside:boolean,hits:array<struct<concept:string,synonyms:array<struct<synonym:string,n:int>>>>>"
# The characters beyond ASCII that Unicode case rules equate with i, k and s
OTHER_CASE = "İıſK"
_ASCII_GAP = r"[ \t\n\x0b\f\r\-]*"


def searchable(synonyms: tuple[str, ...]) -> bool:
    """Whether this module can look for them: none is a raw pattern or empty."""
    return all(not is_raw(s) and re.search(r"[^\s\-]", s) for s in synonyms)


def _python(synonyms: tuple[str, ...]) -> re.Pattern:
    """The synonyms in order, a group each."""
    return re.compile(START + "(?:" + "|".join(f"({core(s).replace('(?iu:', '(?i:').replace(GAP, _ASCII_GAP)})" for s in synonyms) + ")" + END)


def _lead(part: str) -> str:
    return re.match(r"[A-Za-z0-9]*", part)[0]


@dataclass
class Lexicon:
    """What tokens mean to the groups of synonyms: group 0 is the domain, group 1 + k concept k."""

    groups: list[tuple[str, ...]]
    patterns: list[re.Pattern] = field(init=False)
    whole: dict[tuple[bool, str], list[tuple[int, int]]] = field(init=False)
    first: dict[tuple[bool, str], set[int]] = field(init=False)
    odd: list[re.Pattern | None] = field(init=False)

    def __post_init__(self):
        self.patterns = [_python(g) if g else re.compile("(?!)") for g in self.groups]
        self.whole, self.first, self.odd = defaultdict(list), defaultdict(set), []
        for g, synonyms in enumerate(self.groups):
            starts = ""
            for i, s in enumerate(synonyms):
                any_case = is_phrase(s)
                parts = [p.lower() if any_case else p for p in re.split(r"[\s\-]+", s.strip()) if p]
                if not _lead(parts[0]) or set(s) & set(OTHER_CASE):
                    starts += parts[0][0] + (OTHER_CASE + "iks" if set(s) & set(OTHER_CASE) else "")
                    continue
                so_far = ""
                for k, part in enumerate(parts):
                    so_far += _lead(part)
                    if _lead(part) != part or k < len(parts) - 1:
                        self.first[any_case, so_far].add(g)
                    if _lead(part) != part:
                        break
                else:
                    for plural in ("", "s", "es") if any_case else ("", "s"):
                        self.whole[any_case, so_far + plural].append((g, i))
            self.odd.append(re.compile("(?i)[" + re.escape(starts) + "]") if starts else None)

    def of(self, token: str) -> list[tuple[int, int]]:
        """(group, synonym) that the token is in whole, the first a group; (group, -1) where more text decides."""
        low = token.lower()
        out: dict[int, int] = {}
        for key in ((True, low), (False, token)):
            for g, i in self.whole.get(key, ()):
                out[g] = min(i, out.get(g, i))
        for key in ((True, low), (False, token)):
            for g in self.first.get(key, ()):
                out[g] = -1
        return list(out.items())


_IS_TOKEN = np.zeros(256, bool)
_IS_TOKEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _tokens(raw: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """(tokens of all texts, the text of each, where each begins in characters of its text)."""
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    inside = _IS_TOKEN[data]
    turn = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
    start, end = turn[::2], turn[1::2]
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[inside].tobytes()))
    edge = np.cumsum([0, *(len(r) + 1 for r in raw)])
    owner = np.searchsorted(edge, start, side="right") - 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return words.dictionary_encode(), owner, points[start] - points[edge[owner]]


def _tried(pattern: re.Pattern, text: str, places: list[int] | None) -> dict[int, int]:
    """synonym -> matches, tried at these places from left to right, or everywhere."""
    out: dict[int, int] = defaultdict(int)
    if places is None:
        for m in pattern.finditer(text):
            out[m.lastindex - 1] += 1
        return out
    end = 0
    for p in places:
        if p >= end and (m := pattern.match(text, p)):
            out[m.lastindex - 1] += 1
            end = m.end()
    return out


def extracted(lexicon: Lexicon, texts: list[str | None], gated: bool, known: dict[str, list[tuple[int, int]]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(whether each text is in the domain; rows of text, group, synonym, matches of the concepts, sorted).

    ``gated`` leaves out the concepts of texts outside the domain; ``known`` gets what each distinct token means.
    """
    known = {} if known is None else known
    found, owner, place = _tokens([t.encode("utf-8", "surrogatepass") if t else b"" for t in texts])
    words = found.dictionary.to_pylist()
    known.update((t, lexicon.of(t)) for t in words if t not in known)
    meaning = [known[t] for t in words]
    many = np.fromiter(map(len, meaning), np.int64, len(meaning))
    flat = np.array([x for m in meaning for x in m], np.int64).reshape(-1, 2)
    code = np.asarray(found.indices, np.int64)
    token = np.flatnonzero(many[code]) if len(code) else np.zeros(0, np.int64)
    token = np.repeat(token, many[code[token]])
    first = np.cumsum(many) - many
    run = np.arange(len(token)) - np.searchsorted(token, token)
    group, synonym = flat[first[code[token]] + run].T if len(token) else (np.zeros(0, np.int64),) * 2
    doc, n_groups = owner[token], len(lexicon.groups)
    pair = doc * n_groups + group
    everywhere = set()  # (text, group) to be searched in full
    odd = [(g, start) for g, start in enumerate(lexicon.odd) if start]
    for d, t in enumerate(texts):
        if t and not t.isascii() and any(c in t for c in OTHER_CASE):
            everywhere.update(range(d * n_groups, (d + 1) * n_groups))
        elif t and odd:
            everywhere.update(d * n_groups + g for g, start in odd if start.search(t))
    full = np.fromiter(everywhere, np.int64, len(everywhere))
    open_pairs = np.union1d(pair[synonym < 0], full)
    settled = ~np.isin(pair, open_pairs)
    inside = np.zeros(len(texts), bool)
    inside[doc[(group == 0) & (synonym >= 0) & settled]] = True
    order = np.argsort(pair, kind="stable")
    pair_sorted, place_sorted = pair[order], place[token[order]]

    def settled_now(p: int) -> dict[int, int]:
        a, b = np.searchsorted(pair_sorted, [p, p + 1])
        return _tried(lexicon.patterns[p % n_groups], texts[p // n_groups], None if p in everywhere else place_sorted[a:b].tolist())

    for p in open_pairs[open_pairs % n_groups == 0].tolist():
        if not inside[p // n_groups]:
            inside[p // n_groups] = bool(settled_now(p))
    rows = {p: settled_now(p) for p in open_pairs[open_pairs % n_groups > 0].tolist() if inside[p // n_groups] or not gated}
    keep = settled & (group > 0) & (inside[doc] | (not gated))
    whole, n = np.unique(np.stack([doc[keep], group[keep], synonym[keep]]), axis=1, return_counts=True)
    more = np.array([(*divmod(p, n_groups), s, k) for p, counts in rows.items() for s, k in counts.items()], np.int64).reshape(-1, 4)
    out = np.concatenate([np.concatenate([whole, n[None, :]]).T, more])
    return inside, out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]


#: Bytes of texts searched at once: some 30 times as many are held while they are.
BYTES_AT_ONCE = 2 << 20


def as_found(lexicon: Lexicon, keys: list[str], texts: pa.Array, gated: bool) -> pa.StructArray:
    """The extraction of a batch as FOUND, some texts at a time; null texts are neither inside nor outside."""
    known: dict[str, list[tuple[int, int]]] = {}
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    parts = [_as_found(lexicon, keys, texts.slice(a, b - a), gated, known) for a, b in runs(size, BYTES_AT_ONCE)]
    return pa.concat_arrays(parts) if parts else _as_found(lexicon, keys, texts, gated, known)


def _as_found(lexicon: Lexicon, keys: list[str], texts: pa.Array, gated: bool, known: dict[str, list[tuple[int, int]]]) -> pa.StructArray:
    inside, rows = extracted(lexicon, texts.to_pylist(), gated, known)
    names = [s for g in lexicon.groups for s in g]
    base = np.cumsum([0, *map(len, lexicon.groups)])
    doc, group, synonym, n = rows.T
    head = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(group) != 0)]) if len(rows) else np.zeros(0, np.int64)
    listed = pa.StructArray.from_arrays([pa.array(names, pa.string()).take(pa.array(base[group] + synonym)), pa.array(n, pa.int32())], ["synonym", "n"])
    synonyms = pa.ListArray.from_arrays(pa.array(np.r_[head, len(rows)], pa.int32()), listed)
    concept = pa.array(keys, pa.string()).take(pa.array(group[head] - 1))
    hits = pa.StructArray.from_arrays([concept, synonyms], ["concept", "synonyms"])
    edges = np.searchsorted(doc[head], np.arange(len(texts) + 1))
    return pa.StructArray.from_arrays([pa.array(inside, mask=np.asarray(texts.is_null())), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), hits)], ["inside", "hits"])
