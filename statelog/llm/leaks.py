"""Held-out test items that show up in a corpus of wiki pages."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive words that make a leak.
WINDOW = 12
#: Items up to which the set of test windows is broadcast; more are handled in blocks of as many.
ITEM_BLOCK = 20_000

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_REF = re.compile(r"<ref\b[^<>]*?/>|<ref\b[^<>]*>(.*?)</ref\s*>", re.S | re.I)
_PLAIN_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
_LINK = re.compile(r"\[\[([^\[\]]*)\]\]")
_URL_LINK = re.compile(r"\[(?:https?:|ftp:)?//[^\s\]]*\s*([^\]]*)\]")
_TAG = re.compile(r"</?([a-zA-Z]+)(?:\s[^<>]*)?/?>")
_QUOTES = re.compile(r"'{2,}")
_CELL_STYLE = re.compile(r"(^|\|\||!!)([|!])?[^\S\n]*(?:[\w-]+\s*=\s*(?:\"[^\"\n]*\"|[^\s|\"]+)\s*)+\|(?!\|)", re.M)
_TABLE_LINE = re.compile(r"^\s*(?:\{\||\|-).*$", re.M)
_ARGUMENT = re.compile(r"\|\s*[\w -]{1,40}?\s*=")
_NAMED = re.compile(r"\s*[\w -]{1,40}?\s*=")
_SWITCH = re.compile(r"__[A-Z]+__")
_WORD = re.compile(r"[^\W_]+")
_UNSEEN = regex.compile(r"[\p{Mn}\p{Me}\p{Cf}]+")
_HIDDEN = regex.compile(r"\p{Cf}+")
#: Tags that mark words without parting them; other known tags part them.
_INLINE = {"b", "i", "u", "s", "em", "strong", "span", "small", "big", "sup", "sub", "tt", "code", "font", "del", "ins", "mark", "abbr", "cite", "q", "nowiki", "strike", "a", "var", "kbd", "samp", "bdi", "noinclude", "includeonly", "onlyinclude"}
_PARTING = {"br", "p", "div", "li", "ul", "ol", "td", "th", "tr", "table", "hr", "blockquote", "center", "pre", "poem", "dd", "dt", "dl", "h1", "h2", "h3", "h4", "h5", "h6", "caption", "gallery", "references", "ref", "math", "section"}


def _tag(m: re.Match) -> str:
    name = m.group(1).lower()
    return "" if name in _INLINE else " " if name in _PARTING else m.group(0)


def _label(m: re.Match) -> str:
    target, bar, label = m.group(1).rpartition("|")
    if not bar:
        return " " if re.match(r"\s*(?:category|kategorie|catégorie|categoría)\s*:", label, re.I) else label.removeprefix(":")
    return label if label.strip() else target


def _shown(m: re.Match) -> str:
    """What a template like ``{{lang|fr|mot}}`` shows: its last unnamed argument."""
    args = [a for a in m.group(0)[2:-2].split("|")[1:] if not _NAMED.match(a)]
    return args[-1] if args else ""


def words_of(text: str) -> list[str]:
    """Words as a reader compares them: runs of letters and digits without case, accents and invisible characters."""
    if text.isascii():
        return _WORD.findall(text.lower())
    return _WORD.findall(_UNSEEN.sub("", unicodedata.normalize("NFKD", text.casefold())))


def _strip_links(text: str) -> str:
    for _ in range(6):  # links inside captions of files
        if "[[" not in text:
            break
        text, n = _LINK.subn(_label, text)
        if not n:
            break
    return _URL_LINK.sub(r"\1", text) if "[" in text else text


def rendered(text: str) -> list[str]:
    """:func:`views_and_notes` in one list."""
    views, notes = views_and_notes(text)
    return views + notes


def views_and_notes(text: str) -> tuple[list[str], list[str]]:
    """Texts that a reader of the page sees one after another, each without markup.

    The first is the page with what its templates show in place; others, where there is anything to tell apart, are the page without
    templates and notes, the page with its innermost templates replaced by their last unnamed argument, level by level, and the notes. An unclosed comment hides the rest; other unclosed markup is shown as it is.
    """
    text = _COMMENT.sub("", text) if "<!--" in text else text
    text = html.unescape(text) if "&" in text else text
    if not text.isascii():
        text = _HIDDEN.sub("", text)
    tags = "<" in text
    notes = [m.group(1) for m in _REF.finditer(text) if m.group(1)] if tags else []
    body = _strip_links(_REF.sub("", text) if tags else text)
    views = [body]
    if "{{" in body:
        bare = body
        for _ in range(8):
            bare, n = _PLAIN_TEMPLATE.subn("", bare)
            if not n:
                break
        if bare != body:
            views.append(bare)
        views[0] = _ARGUMENT.sub("| ", body)
        shown = body
        for _ in range(8):
            shown, n = _PLAIN_TEMPLATE.subn(_shown, shown)
            if not n:
                break
            views.append(_ARGUMENT.sub("| ", shown))
    return [_without_marks(v) for v in views], [_without_marks(_strip_links(n)) for n in notes]


def _without_marks(text: str) -> str:
    if "|" in text:
        text = _CELL_STYLE.sub(r"\1 ", _TABLE_LINE.sub(" ", text)) if "=" in text else _TABLE_LINE.sub(" ", text)
    text = _TAG.sub(_tag, text) if "<" in text else text
    text = _QUOTES.sub("", text) if "''" in text else text
    return _SWITCH.sub("", text) if "__" in text else text


class LeakFinder:
    """Finds windows of test items in texts. ``items`` are (item_id, text); items of fewer words than the window have none."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        self.window, self.number, self.windows = window, {}, {}
        self.run = b"\1" * window
        for item_id, text in items:
            w = [self.number.setdefault(x, len(self.number)) for x in words_of(text or "")]
            for k in range(len(w) - window + 1):
                self.windows.setdefault(tuple(w[k : k + window]), set()).add(item_id)

    def spans(self, text: str) -> Iterator[tuple[int, int, int]]:
        """``(item_id, first word, words)`` of each stretch of words that an item shares with ``text``."""
        n, get, windows = self.window, self.number.get, self.windows
        words = words_of(text)
        if self.run not in bytes(map(self.number.__contains__, words)):  # never so many words of items in a row
            return
        w = [get(x, -1) for x in words]
        open_at: dict[int, list[int]] = {}
        known = 0
        for k, x in enumerate(w):
            known = known + 1 if x >= 0 else 0
            if known < n:
                continue
            for item in windows.get(tuple(w[k - n + 1 : k + 1]), ()):
                has = open_at.get(item)
                if has and has[1] >= k - n + 1:
                    has[1] = k + 1
                else:
                    if has:
                        yield item, has[0], has[1] - has[0]
                    open_at[item] = [k - n + 1, k + 1]
        for item, (a, b) in open_at.items():
            yield item, a, b - a

    def leaks(self, text: str | None) -> dict[int, int]:
        """Items that a page shows, with the words of the longest stretch."""
        found: dict[int, int] = {}
        for view in dict.fromkeys(rendered(text)) if text else ():
            for item, _, n in self.spans(view):
                found[item] = max(n, found.get(item, 0))
        return found

    def without_spans(self, text: str | None) -> str | None:
        """A page without what it shows of test items; a page that shows none is returned as it is.

        Otherwise the page's words with what templates show in place, then those of its notes, in plain form and without every leaked
        stretch. A stretch that is only seen in another view, as templates or their arguments interrupt it, goes with what interrupts
        it. GAP stands where words went, so the words on both sides don't become neighbours.
        """
        if not text:
            return text
        views, notes = views_and_notes(text)
        if not any(True for v in views + notes for _ in self.spans(v)):
            return text
        body = words_of(views[0])
        drop = self._dropped(views[0])
        for v in views[1:]:
            words = words_of(v)
            for _, a, n in self.spans(v):
                drop.update(_interrupted(body, words[a : a + n], drop))
        out = _with_gaps(body, drop)
        for v in notes:
            out += [GAP, *_with_gaps(words_of(v), self._dropped(v))]
        return " ".join(out)

    def _dropped(self, view: str) -> set[int]:
        return {k for _, a, n in self.spans(view) for k in range(a, a + n)}


#: A letter that no text uses as a word; it stands in a cleaned text for words that were taken out.
GAP = "ʬ"


def _with_gaps(words: list[str], drop: set[int]) -> list[str]:
    return [GAP if k in drop else x for k, x in enumerate(words) if k not in drop or k - 1 not in drop]


def _interrupted(words: list[str], span: list[str], drop: set[int]) -> range:
    """Places of the shortest stretch of ``words`` that holds ``span`` in order, with what interrupts it, from a word on that isn't dropped yet.

    A stretch that lies in the page's words in another order isn't found here; none of its words are neighbours there.
    """
    best: range = range(0)
    for a in (k for k, x in enumerate(words) if x == span[0] and k not in drop):
        k, at = a, 0
        while k < len(words) and at < len(span) and (not best or k - a < len(best)):
            at += words[k] == span[at]
            k += 1
        if at == len(span) and (not best or k - a < len(best)):
            best = range(a, k)
    return best


def _blocks(items: DataFrame, block: int) -> list[DataFrame]:
    """``items`` in parts of about ``block`` rows."""
    n = max(1, -(-items.count() // block))
    return [items] if n == 1 else [items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n)]


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = ITEM_BLOCK) -> DataFrame:
    """``(doc_id, item_id, words)``: documents that show at least ``window`` consecutive words of an item, and the longest stretch.

    Null and empty texts show nothing. Test items are few and come to the driver in blocks of ``block``; documents are scanned once
    a block, without a shuffle. Rows with equal doc_id are scanned each for itself. No documents or no items give no rows.
    """
    spark = docs.sparkSession
    docs = docs.where("text is not null").select("doc_id", "text")
    out = None
    for part in _blocks(items.select("item_id", "text"), block):
        rows = sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[0] is None, r[0], r[1] or ""))
        shared = spark.sparkContext.broadcast([r for r in rows if r[0] is not None])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = LeakFinder(shared.value, window)
            for b in batches:
                ids, hits, n = [], [], []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for item, words in finder.leaks(text).items():
                        ids.append(doc)
                        hits.append(item)
                        n.append(words)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hits, pa.int64()), pa.array(n, pa.int32())], ["doc_id", "item_id", "words"])

        found = docs.mapInArrow(run, "doc_id bigint, item_id bigint, words int")
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents that show no test item."""
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = ITEM_BLOCK) -> DataFrame:
    """``(doc_id, text)``: each document without the stretches it shares with test items; see :meth:`LeakFinder.without_spans`.

    Null texts stay null. Items come in blocks as in :func:`find_leaks`; a document goes through one block after another.
    """
    spark = docs.sparkSession
    out = docs.select("doc_id", "text")
    for part in _blocks(items.select("item_id", "text"), block):
        shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in part.collect() if r[0] is not None])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = LeakFinder(shared.value, window)
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([finder.without_spans(t) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

        out = out.mapInArrow(run, "doc_id bigint, text string")
    return out
