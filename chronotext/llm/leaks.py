"""Held-out passages inside a corpus.

All ten-word windows of the held-out items form one Aho-Corasick automaton over words. Each document is normalised and
scanned once; places found are mapped back to the original text.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = 10
#: Words of items in one automaton (some 100 MB at most); more items are scanned for in several passes.
AUTOMATON_WORDS = 500_000
#: Hyphens at line ends in ten words of an item that are read in every way.
DENSE = 12

# Tags that end a line or cell; all others stand inside the text.
BLOCK = "br|p|div|li|ul|ol|td|th|tr|table|h[1-6]|hr|pre|blockquote|section|article|dd|dt"
_BLOCK_TAG = re.compile(rf"</?(?:{BLOCK})\b[^<>]*>", re.I)
_TAG = re.compile(r"<!--.*?-->|<\|[^<>|]*\|>|</?[A-Za-z][^<>]*>", re.S)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
# Format characters, fillers, variation selectors, combining marks and controls carry no letter of their own.
_UNSEEN = re.compile(
    r"[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164"
    r"\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e0fff\u0300-\u036f\x00-\x08\x0e-\x1f\x7f]"
)
_BREAK = r"[-\u2010\u2011\u00ac][ \t\u00a0]*(?:\r\n?|\n)[\s>|*]*"
# A soft hyphen at a line end always splits a word.
_SOFT_BREAK = re.compile(r"\u00ad[ \t\u00a0]*(?:\r\n?|\n)[\s>|*]*")
_SPLIT_WORD = re.compile(rf"(?<=[^\W_]){_BREAK}(?=[^\W_])")
_RUN, _PIECE = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+|[\x00-\x7f]"), re.compile(r".[\u0300-\u036f]*", re.S)
_PLAIN = re.compile(r"[^\W_]+")


def _fold(text: str) -> str:
    return _UNSEEN.sub("", unicodedata.normalize("NFKC", text)).casefold()


def normalised(text: str) -> str:
    """Without tags, with entities decoded, compatibility forms and case folded and unseen characters dropped."""
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub(" ", text))
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m.group()), text)
    if "\u00ad" in text:
        text = _SOFT_BREAK.sub("", text)
    return text.lower() if text.isascii() and text.isprintable() else _fold(text)


def _marked(plain: str) -> tuple[list[str], list[tuple[int, int]], list[bool] | None]:
    """The words of a normalised text, where they stand, and after which of them a hyphen at a line end follows (None: after none)."""
    found = list(_PLAIN.finditer(plain))
    words, places = [m.group() for m in found], [m.span() for m in found]
    breaks = {m.span() for m in _SPLIT_WORD.finditer(plain)} if "\n" in plain or "\r" in plain else ()
    return words, places, [(places[i][1], places[i + 1][0]) in breaks for i in range(len(words) - 1)] + [False] if breaks else None


def words_of(text: str | None) -> tuple[list[str], list[bool] | None]:
    """The words of a text, those that a hyphen at a line end parts for themselves, and after which of them such a hyphen follows: each may split a word or join two."""
    words, _, parted = _marked(normalised(text)) if text else ([], [], None)
    return words, parted


def _replaced(pattern: re.Pattern, new: Callable[[str], str], text: str, at: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """``pattern.sub`` that carries ``at``, where each character stands in the original."""
    parts: list[str] = []
    places: list[tuple[int, int]] = []
    last = 0
    for m in pattern.finditer(text):
        parts += [text[last : m.start()], piece := new(m.group())]
        places += at[last : m.start()]
        places += [(at[m.start()][0], at[m.end() - 1][1])] * len(piece)
        last = m.end()
    return "".join([*parts, text[last:]]), places + at[last:]


def _folded_at(text: str, at: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """``_fold`` that carries ``at``; characters that fold otherwise together than alone share their place."""
    parts: list[str] = []
    places: list[tuple[int, int]] = []
    # Nothing combines with an ASCII character that follows it.
    for m in _RUN.finditer(text):
        pieces = [(_fold(p.group()), m.start() + p.start(), m.start() + p.end()) for p in _PIECE.finditer(m.group())]
        if "".join(p for p, _, _ in pieces) != (whole := _fold(m.group())):
            pieces = [(whole, m.start(), m.end())]
        for piece, start, stop in pieces:
            parts.append(piece)
            places += [(at[start][0], at[stop - 1][1])] * len(piece)
    return "".join(parts), places


def words_at(text: str) -> tuple[list[str], list[tuple[int, int]], list[bool] | None]:
    """``words_of`` with the words' places in the original text."""
    plain, at = text, [(i, i + 1) for i in range(len(text))]
    plain, at = _replaced(_BLOCK_TAG, lambda _: " ", plain, at)
    plain, at = _replaced(_TAG, lambda _: "", plain, at)
    plain, at = _replaced(_ENTITY, html.unescape, plain, at)
    plain, at = _replaced(_SOFT_BREAK, lambda _: "", plain, at)
    plain, at = _folded_at(plain, at)
    words, places, parted = _marked(plain)
    return words, [(at[a][0], at[b - 1][1]) for a, b in places], parted


def _next_words(words: list[str], parted: list[bool], at: int) -> Iterator[tuple[str, int]]:
    """What may be read as one word from ``at`` on, and where the next begins: hyphens at line ends may be passed over."""
    word = words[at]
    yield word, at + 1
    while parted[at]:
        at += 1
        word += words[at]
        yield word, at + 1


def _item_windows(words: list[str], parted: list[bool] | None, run: int) -> Iterator[tuple[str, ...]]:
    """All windows of ``run`` words of an item, its own hyphens at line ends read either way, each for itself.

    Where more than DENSE of them stand in ``run`` words, they all split words or all join them.
    """
    if parted is None:
        yield from (tuple(words[i : i + run]) for i in range(len(words) - run + 1))
        return
    dense = any(sum(parted[i : i + run]) > DENSE for i in range(len(words)))
    if dense:
        yield from _item_windows(words, None, run)
        yield from _item_windows(_joined(words, parted)[0], None, run)
        return
    for start in range(len(words)):
        paths = [((), start)]
        while paths:
            path, at = paths.pop()
            if len(path) == run:
                yield path
            elif at < len(words):
                paths += [((*path, word), after) for word, after in _next_words(words, parted, at)]


def _joined(words: list[str], parted: list[bool] | None) -> tuple[list[str], list[int]]:
    """The reading in which all hyphens at line ends split words, and at which of ``words`` each of its words begins."""
    if parted is None:
        return words, list(range(len(words)))
    begins = [i for i in range(len(words)) if not i or not parted[i - 1]]
    return ["".join(words[a:b]) for a, b in zip(begins, [*begins[1:], len(words)])], begins


class Windows:
    """The automaton of all windows of ``run`` words of the items."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN):
        import ahocorasick

        self.run, self.number, windows = run, {}, {}
        for item, text in items:
            for window in _item_windows(*words_of(text), run):
                codes = tuple(self.number.setdefault(w, len(self.number) + 1) for w in window)
                windows.setdefault(codes, set()).add(item)
        self.items = [sorted(ids) for ids in windows.values()]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, window in enumerate(windows):
            self.automaton.add_word(window, i)
        if windows:
            self.automaton.make_automaton()

    def hits(self, words: list[str], parted: list[bool] | None) -> set[tuple[int, int, int, int]]:
        """(item, first word, second word, word after the last) of every window that occurs in any reading of the hyphens at line ends.

        The automaton scans the reading in which all of them split words. From the words that have such a hyphen close ahead or just behind them its tree is
        followed along all other readings, as far as windows begin so.
        """
        found: set[tuple[int, int, int, int]] = set()
        if not self.items or len(words) < self.run:
            return found
        joined, begins = _joined(words, parted)
        begins = [*begins, len(words)]
        if len(joined) >= self.run:
            for end, i in self.automaton.iter(tuple(self.number.get(w, 0) for w in joined)):
                start = end - self.run + 1
                found.update((item, begins[start], begins[start + 1], begins[end + 1]) for item in self.items[i])
        if parted:
            near = {start for k, cut in enumerate(parted) if cut for start in range(max(0, k - self.run + 1), k + 2)}
            for start in near:
                paths = [((), start, start)]
                while paths:
                    path, second, at = paths.pop()
                    for word, after in _next_words(words, parted, at) if at < len(words) else ():
                        if code := self.number.get(word):
                            longer = (*path, code)
                            if len(longer) < self.run:
                                if self.automaton.match(longer):
                                    paths.append((longer, second if path else after, after))
                            elif (i := self.automaton.get(longer, -1)) >= 0:
                                found.update((item, start, second if path else after, after) for item in self.items[i])
        return found

    def found(self, text: str | None) -> set[int]:
        return {hit[0] for hit in self.hits(*words_of(text))}

    def spans(self, text: str | None) -> set[tuple[int, int, int]]:
        """(item, start, end) of the longest stretches of windows that follow word by word, as places in the original text."""
        if not text:
            return set()
        words, places, parted = words_at(text)
        out: list[tuple[int, int, int]] = []
        last: tuple[int, int] | None = None
        follows: set[int] = set()
        for item, first, second, after in sorted(self.hits(words, parted)):
            if last and last[0] == item and (first in follows or first == last[1]):
                follows = {second} if first != last[1] else follows | {second}
                out[-1] = (item, out[-1][1], max(out[-1][2], after))
            else:
                out.append((item, first, after))
                follows = {second}
            last = (item, first)
        return {(item, places[a][0], places[b - 1][1]) for item, a, b in out}


_windows: dict[str, Windows] = {}


def _automaton(key: str, items: list[tuple[int, str]], run: int) -> Windows:
    if key not in _windows:
        _windows.clear()
        _windows[key] = Windows(items, run)
    return _windows[key]


def _scan(documents: DataFrame, items: DataFrame, run: int, places: bool) -> DataFrame:
    spark = documents.sparkSession
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    passes = max(1, math.ceil(total / AUTOMATON_WORDS))
    schema = "doc_id bigint, item_id bigint" + (", start int, stop int" if places else "")
    columns = [c.split()[0] for c in schema.split(", ")]
    name, result = uuid.uuid4().hex, None
    for n in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == n).orderBy("item_id", "text")
        shard = spark.sparkContext.broadcast([(r.item_id, r.text) for r in part.collect()])

        def scan(batches: Iterator[pd.DataFrame], shard=shard, key=f"{name}/{n}") -> Iterator[pd.DataFrame]:
            windows = _automaton(key, shard.value, run)
            for batch in batches:
                rows = []
                for doc, text in zip(batch["doc_id"], batch["text"]):
                    if items_found := windows.found(text):
                        rows += [(doc, *span) for span in windows.spans(text)] if places else [(doc, item) for item in items_found]
                yield pd.DataFrame(rows, columns=columns)

        found = documents.mapInPandas(scan, schema)
        result = found if result is None else result.unionByName(found)
    return result.distinct()


def leaks(documents: DataFrame, items: DataFrame, *, doc_id: Column, text: Column, item_id: Column, item_text: Column, run: int = RUN) -> DataFrame:
    """``doc_id``, ``item_id``: documents that hold at least ``run`` consecutive words of an item.

    Each hyphen at a line end may split a word or join two, whatever the others do. Null and blank texts and items of fewer words match nothing; an item entered twice counts under both ids, repeated
    rows once; empty tables give no rows. The items are sent to the workers in parts of bounded size, one pass over the
    corpus for each part.
    """
    docs, held = _inputs(documents, items, doc_id, text, item_id, item_text)
    return _scan(docs, held, run, places=False)


def leak_spans(documents: DataFrame, items: DataFrame, *, doc_id: Column, text: Column, item_id: Column, item_text: Column, run: int = RUN) -> DataFrame:
    """``leaks`` with ``start`` and ``stop``: where the stretch stands in the original text, in code points."""
    docs, held = _inputs(documents, items, doc_id, text, item_id, item_text)
    return _scan(docs, held, run, places=True)


def _inputs(documents, items, doc_id, text, item_id, item_text) -> tuple[DataFrame, DataFrame]:
    docs = documents.select(doc_id.cast("bigint").alias("doc_id"), text.alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    held = items.select(item_id.cast("bigint").alias("item_id"), item_text.alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    return docs, held
