"""Pages stitched from replicated phrases: keyword stuffing, link lists, tag clouds and offer lists.

Phrases are the word shingles of up to ``LONGEST`` words of every page, in lists and in running text
alike; a shingle doesn't cross a list delimiter, a link or the end of a sentence. The distinct hosts of
each are counted over all pages. A phrase found on ``HOSTS`` hosts is *replicated*, however many hosts
there are. Ordinary wording is replicated too, so host counts are joined with list density: of the pages
that hold a stuffing phrase, the share ``LISTED`` at least is list-like, which a page is if at least half of its words stand between
list delimiters in pieces of at most ``PIECE`` words. A phrase that stands on no page without a longer one is left to that one.
Each page is then read as a whole, and the replicated phrases are laid over its words; the words so
covered, links and offers, against all words but those of one heading and one sentence, give its
stitched share. It is joined with list-density evidence: delimiters, links, repeated words and the
want of sentences. A page whose density fits no flag is not laid over, as its stitched share can't matter.

A phrase of ``HOSTS`` pages, a share ``LISTED`` of them list-like, is on ``LISTED * HOSTS`` list-like pages at
least. So the shingles of all pages are held against a filter of fixed size of those that are on so many, before they are
shuffled; what it lets through falsely meets nothing in the join after it, so no result changes. A batch
names at most ``HOSTS`` hosts of a shingle, which tell that it is replicated, and counts all of its pages, so a host or
phrase that holds a third of all pages costs no more than any other.
The replicated phrases are broadcast while they are at most ``BROADCAST_PHRASES``; beyond that each
page's own phrases are joined with them by hash, with the same result.

Defined results: null and empty texts and texts without words are no such pages; null hosts count
as one host; repeated pages are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normforge.llm.names import GARBLED, repaired
from normforge.operators.mining import Filter, Letters, _mixed, _portions
from normforge.session import stored

#: Words of a phrase at most, items of a list run and hosts of a replicated phrase at least, words of the pieces that make a page list-like.
LONGEST, RUN, HOSTS, PIECE = 4, 6, 5, 8
#: Share of a stuffing phrase's pages that are list-like at least.
LISTED = 0.25
#: Stitched share and list density that together flag a page: much of the one needs less of the other.
FLAGS = ((0.45, 0.9), (0.6, 0.6), (0.7, 0.38))
LEAST_DENSITY = min(density for _, density in FLAGS)
BROADCAST_PHRASES = 200_000
#: Words that a link or offer counts as, letters of a glue word, share that known phrases and links cover at least, the share that makes a word repeated,
#: words of the heading and the sentence that may stand beside, and covered words that a flagged page has at least.
LINK_WORDS, GLUE_LETTERS, GATE, REPEATED, SPARE_WORDS, LEAST_HIT = 2, 5, 0.15, 0.04, 45, 6
URL = re.compile(r"(?:https?://|www\.)[^\s<>()\"|\]]+|\b[a-z][\w-]*+(?=\.\w)(?:(?:\.[\w-]+)*\.(?:[a-z]{2,12})(?:/[^\s<>()\"|\]]*)|\.[\w-]+\.[a-z]{4,12}\b)", re.I)
PRICE = re.compile(r"(?:[$€£]\s?|\b(?:ab|only|from|dès|nur)\s)\d+[.,]\d\d\b|\(\d+\)\s?★|★+")
WORD = re.compile(r"\w+(?:['’+.-]+\w+)*")
DELIMITER = re.compile(r"[\n,|>/*•★;·»#\[\]()\t]")
ITEM_EDGE = re.compile(r"[\n,|>/*•★;·»#\[\]()\t]+|\s-\s|<[^>]*>")
SENTENCE_EDGE = re.compile(r"(?<=[.!?:])\s+|\n+")
DOT = re.compile(r"\.[a-zA-Z]|://")
OFFER = re.compile(r"[.,]\d\d\b|★")
#: Without one of these, a text has no link or no price; a link reaches from blank to blank at most.
LINK_SIGN, PRICE_SIGN, BLANK = re.compile(r"\.[a-zA-Z]|://|www\."), re.compile(r"[$€£★]|(?:ab|only|from|dès|nur)\s\d"), re.compile(r"[ \n]")
#: Delimiters that stand between blanks like words.
LONE = (" - ", " > ", " | ", " * ", " / ", " · ", "• ", "★ ", "» ", "# ", " ; ", "- ")
#: What a link or offer is replaced by.
LINK = " \x01 "
ENTITY = re.compile(r"&(?:amp|nbsp|quot|lt|gt|#\d+);")
#: Bits of the kinds of letters: parts of words, what joins them, edges of shingles, ends of sentences, blanks and hyphens.
IN_WORD, JOINS, EDGE, ENDS, SPACE, HYPHEN = 1, 2, 4, 8, 16, 32


def cleaned(text: str) -> str:
    if GARBLED.search(text):
        text = repaired(text)
    return ENTITY.sub(" ", text).replace("\xa0", " ").replace("_", " ").replace("\r\n", "\n")


def list_like(text: str) -> bool:
    total = short = 0
    for piece in DELIMITER.split(text):
        n = len(piece.split())
        total += n
        if n <= PIECE:
            short += n
    return 2 * short >= total


def plain_of(text: str) -> str:
    """A cleaned text with LINK instead of each link and offer."""
    if DOT.search(text):
        out, done = [], 0
        for sign in LINK_SIGN.finditer(text):
            at = sign.start()
            if at >= done:
                begin = max(text.rfind(" ", done, at), text.rfind("\n", done, at)) + 1 or done
                blank = BLANK.search(text, at)
                end = blank.start() if blank else len(text)
                out += text[done:begin], URL.sub(LINK, text[begin:end])
                done = end
        text = "".join([*out, text[done:]])
    return PRICE.sub(LINK, text) if OFFER.search(text) and PRICE_SIGN.search(text) else text


@cache
def kinds() -> np.ndarray:
    """The kind of every letter, by its code point."""
    out, every = np.zeros(0x110000, np.uint8), "".join(map(chr, range(0x110000)))
    for kind, letters in ((IN_WORD, r"\w+"), (SPACE, r"\s+"), (JOINS, r"['’+.-]"), (EDGE, r"[\n,|>/*•★;·»#\[\]()\t<\x01]"), (ENDS, r"[.!?:]"), (HYPHEN, "-")):
        for m in re.finditer(letters, every):
            out[m.start() : m.end()] |= kind
    return out


def changes(values: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before it."""
    return np.concatenate((np.ones(min(len(values), 1), bool), values[1:] != values[:-1]))


class Shingles:
    """The word shingles of some texts: of each its hash, its text and where it begins and ends."""

    def __init__(self, texts: list[str]):
        self.letters = letters = Letters([f"{t}\n" for t in texts])
        kind = kinds()[np.frombuffer("".join(letters.texts).encode("utf-32-le"), np.uint32)]
        before, after = np.concatenate(([SPACE], kind[:-1])).astype(np.uint8), np.concatenate((kind[1:], [SPACE])).astype(np.uint8)
        word, joins = kind & IN_WORD > 0, kind & JOINS > 0
        # joining letters between two parts of a word belong to it
        first, last = np.flatnonzero(joins & (before & JOINS == 0)), np.flatnonzero(joins & (after & JOINS == 0))
        inner = (before[first] & IN_WORD > 0) & (after[last] & IN_WORD > 0)
        change = np.zeros(len(kind) + 1, np.int8)
        change[first[inner]] += 1
        change[last[inner] + 1] -= 1
        word |= np.cumsum(change[:-1], dtype=np.int8) > 0
        edge = (kind & EDGE > 0) | ((after & SPACE > 0) & ((kind & ENDS > 0) | ((kind & HYPHEN > 0) & (before & SPACE > 0))))
        turns = np.flatnonzero(np.diff(word, prepend=False, append=False))
        first, last = turns[::2], turns[1::2]
        piece = np.cumsum(edge)[first]
        single = _mixed(letters.hashes(first, last - first))
        hashes, starts, ends, running = [], [], [], np.zeros(len(first), np.uint64)
        for n in range(1, LONGEST + 1):
            k = max(len(first) - n + 1, 0)
            running = running[:k] * np.uint64(0x9E3779B97F4A7C15) + single[n - 1 : n - 1 + k]
            whole = np.flatnonzero(piece[:k] == piece[n - 1 : n - 1 + k])
            hashes.append(_mixed(running[whole] + np.uint64(n)))
            starts.append(first[whole])
            ends.append(last[whole + n - 1])
        self.hashes, self.starts, self.ends = map(np.concatenate, (hashes, starts, ends))

    def owners(self, which: np.ndarray) -> np.ndarray:
        """The text that each of these shingles stands in."""
        return self.letters.owner[self.starts[which]]

    def phrases(self) -> Iterator[tuple[int, str, int]]:
        """(hash, phrase, texts that hold it); like items of lists, phrases have three letters at least and one that is no digit."""
        order = np.argsort(self.hashes, kind="stable")
        hashes, owners = self.hashes[order], self.owners(order)
        once = np.flatnonzero(changes(hashes) | changes(owners))
        begins = np.flatnonzero(changes(hashes[once]))
        which = order[once[begins]]
        first = self.starts[which]
        columns = (self.hashes[which].view(np.int64), self.letters.owner[first], self.letters.at[first], self.ends[which] - first, np.diff(begins, append=len(once)))
        for h, o, i, size, n in zip(*(c.tolist() for c in columns), strict=True):
            phrase = " ".join(words_of(self.letters.texts[o][i : i + size]))
            if len(phrase) > 2 and any(c.isalpha() for c in phrase):
                yield h, phrase, n


class Gate:
    """Tells pages that known phrases and links don't cover for the share GATE, by an upper bound that needs no words."""

    def __init__(self, known: frozenset[str]):
        self.automaton = ahocorasick.Automaton()
        for phrase in known:
            self.automaton.add_word(phrase, (len(phrase), phrase.count(" ") + 1))
        if known:
            self.automaton.make_automaton()

    def passes(self, text: str) -> bool:
        low = f" {cleaned(text).lower()} "
        most = sum(n for end, (size, n) in self.automaton.iter(low) if not (low[end + 1].isalnum() or low[end - size].isalnum())) if len(self.automaton) else 0
        most += LINK_WORDS * (len(DOT.findall(low)) + low.count("://") + len(OFFER.findall(low)))
        blanks = low.count(" ") + low.count("\n") + low.count("\t")
        words = blanks + 1 if 2 * blanks < len(low) else len(low.split())
        return most >= GATE * (words - sum(map(low.count, LONE)))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def list_items(text: str) -> set[str]:
    """Shingles of one to four words that stand as items in list runs; numbers alone are none."""
    out, run = set(), []

    def close() -> None:
        if len(run) >= RUN:
            out.update(run)
        run.clear()

    if OFFER.search(text):
        text = PRICE.sub(" , ", text)
    if DOT.search(text):
        text = URL.sub(" , ", text)
    for piece in ITEM_EDGE.split(text):
        words = words_of(piece)
        if len(words) > LONGEST:
            close()
        elif words:
            run.append(" ".join(words))
    close()
    return {i for i in out if len(i) > 2 and any(c.isalpha() for c in i)}


def listed(text: str) -> bool:
    """Whether a page is list-like and has a list run with a phrase in it."""
    return list_like(text) and bool(list_items(cleaned(text)))


class Phrases:
    """Known phrases, and the length of the longest that begins with a word."""

    __slots__ = ("known", "longest")

    def __init__(self, known: Iterable[str]):
        self.known = frozenset(known)
        self.longest: dict[str, int] = {}
        for phrase in self.known:
            words = phrase.split(" ")
            self.longest[words[0]] = max(self.longest.get(words[0], 0), len(words))


def marks(words: list[str], phrases: Phrases) -> bytearray:
    """1 for each word under the longest known phrases that begin at any word; a single short word between two of them is their glue."""
    n = len(words)
    out, at = bytearray(n), 0
    known, longest = phrases.known, phrases.longest
    for k, word in enumerate(words):
        if word not in longest:
            continue
        for size in range(min(longest[word], n - k), max(at - k, 0), -1):
            if (word if size == 1 else " ".join(words[k : k + size])) in known:
                out[k : k + size] = b"\1" * size
                at = k + size
                break
    if not at:
        return out
    for k in range(1, n - 1):
        if not out[k] and out[k - 1] == 1 and out[k + 1] == 1 and len(words[k]) <= GLUE_LETTERS:
            out[k] = 2
    return out


def evidence(text: str | None, known: Phrases) -> tuple[float, float]:
    """(stitched share, list density) of a page, both from 0 to 1; the share is 0 where the density fits no flag."""
    text = cleaned(text or "").lower()
    plain = plain_of(text)
    parts = [(WORD.findall(part), part.count(LINK)) for part in SENTENCE_EDGE.split(plain)]
    n, links, delimiters = sum(len(words) for words, _ in parts), plain.count(LINK), len(ITEM_EDGE.findall(text))
    if not n and not links:
        return 0.0, 0.0
    counts = Counter(chain.from_iterable(words for words, _ in parts))
    density = max(min(1.0, 2.5 * delimiters / max(n, 1)), 1 - len(counts) / max(n, 1), min(1.0, 4 * links / max(n, 1)))
    if density < LEAST_DENSITY:
        return 0.0, density
    parts = [(words, marks(words, known), here) for words, here in parts if words or here]
    total = n + LINK_WORDS * links
    if LINK_WORDS * links + sum(m.count(1) for _, m, _ in parts) < GATE * total:
        return 0.0, density
    # what the page itself repeats counts beside known phrases
    often = max(4, REPEATED * n)
    own = {w for w, c in counts.items() if c >= often and (len(w) > 4 or any(ch.isdigit() for ch in w))}
    for words, m, _ in parts:
        for k, w in enumerate(words):
            if w in own:
                m[k] = 1
    hit = LINK_WORDS * links + sum(len(m) - m.count(0) for _, m, _ in parts)
    free = sorted((m.count(0) for words, m, here in parts if m.count(0) + here < 0.6 * len(words) + 1 or m.count(0) > 0.5 * len(words)), reverse=True)
    spare = min(sum(free[:2]), SPARE_WORDS, 0.6 * total)
    stitched = min(hit / max(total - spare, 1), 1.0) if hit >= LEAST_HIT else 0.0
    return stitched, density


def replicated_phrases(df: DataFrame, text: str = "text", host: str = "site") -> DataFrame:
    """(phrase) of the word shingles of all pages that are found on enough distinct hosts and belong to lists."""
    pages = df.select(F.col(text).cast("string").alias("text"), F.xxhash64(F.coalesce(F.col(host).cast("string"), F.lit(""))).alias("host")).where("text is not null and text != ''")

    def of_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found, counts = [plain_of(cleaned(t).lower()) for t in batch.column(0).to_pylist() if listed(t)], {}, Counter()
            for portion in _portions([len(t) for t in texts]):
                for h, phrase, n in Shingles(texts[portion]).phrases():
                    found[h] = phrase
                    counts[h] += n
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.string()), pa.array([counts[h] for h in found], pa.int64())], ["h", "phrase", "pages"])

    # a phrase on enough hosts is on as many pages, and this share of them is list-like
    candidates = pages.select("text").mapInArrow(of_lists, "h long, phrase string, pages long").groupBy("h", "phrase").agg(F.sum("pages").alias("pages"))
    candidates = stored(candidates.where(F.col("pages") >= LISTED * HOSTS).drop("pages"))
    ready = df.sparkSession.sparkContext.broadcast(Filter.of(candidates.select("h"), candidates.count()))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = Filter(*ready.value)
        for batch in batches:
            host = batch.column(1).to_numpy()
            order = np.argsort(host)
            texts, host = batch.column(0).take(pa.array(order)).to_pylist(), host[order]
            of_list = np.fromiter(map(listed, texts), bool, len(texts))
            hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for portion in _portions([len(t) for t in texts]):
                shingles = Shingles([plain_of(cleaned(t).lower()) for t in texts[portion]])
                which = np.flatnonzero(among.holds(shingles.hashes))
                hashes.append(shingles.hashes[which])
                owners.append(shingles.owners(which) + portion.start)
            h, page = np.concatenate(hashes), np.concatenate(owners)
            # equal shingles stand in the order of their pages, and these in the order of their hosts
            order = np.argsort(h, kind="stable")
            h, page = h[order], page[order]
            once = changes(h) | changes(page)
            h, page = h[once], page[once]
            begins = np.flatnonzero(changes(h) | changes(host[page]))
            # HOSTS of its hosts tell that a shingle is replicated; pages of further ones are counted with the last of these
            place = np.arange(len(begins))
            begins = begins[place - np.maximum.accumulate(np.where(changes(h[begins]), place, 0)) < HOSTS]
            ends = np.append(begins[1:], len(h))[: len(begins)]
            lists = np.concatenate(([0], np.cumsum(of_list[page])))
            yield pa.RecordBatch.from_arrays([pa.array(h[begins].view(np.int64)), pa.array(host[page[begins]]), pa.array(ends - begins), pa.array(lists[ends] - lists[begins])], ["h", "host", "pages", "listed"])

    totals = [F.sum(c).alias(c) for c in ("pages", "listed")]
    by_host = pages.mapInArrow(counts, "h long, host long, pages long, listed long").groupBy("h", "host").agg(*totals)
    among_lists = by_host.groupBy("h").agg(F.count(F.lit(1)).alias("hosts"), *totals).where((F.col("hosts") >= HOSTS) & (F.col("listed") >= LISTED * F.col("pages")))
    phrases = stored(among_lists.join(candidates, "h").select("phrase", "pages"))
    # where both are on as many pages, they are on the same ones
    inside = [phrases.where("phrase like '% %'").select(F.regexp_replace("phrase", edge, "").alias("phrase"), F.col("pages")) for edge in (r"^[^ ]+ ", r" [^ ]+$")]
    return phrases.join(inside[0].unionByName(inside[1]).distinct(), ["phrase", "pages"], "left_anti").select("phrase")


def page_evidence(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "site") -> DataFrame:
    """(key, stitched, listed) of every page; both are 0 where not even the share GATE is covered."""
    phrases = replicated_phrases(df, text, host)
    pages = df.select(F.col(key), F.col(text).cast("string").alias("page_text"))
    key_type = dict(pages.dtypes)[key]
    schema = f"`{key}` {key_type}, stitched double, listed double"
    some = phrases.select("phrase").limit(BROADCAST_PHRASES + 1).collect()

    def result(keys: pa.Array, found: list[tuple[float, float]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, pa.array([s for s, _ in found], pa.float64()), pa.array([d for _, d in found], pa.float64())], [key, "stitched", "listed"])

    if len(some) <= BROADCAST_PHRASES:
        known = df.sparkSession.sparkContext.broadcast(frozenset(r.phrase for r in some))

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gate, phrases = Gate(known.value), Phrases(known.value)
            for batch in batches:
                yield result(batch.column(0), [evidence(t, phrases) if t and gate.passes(t) else (0.0, 0.0) for t in batch.column(1).to_pylist()])

        return pages.mapInArrow(judge, schema)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(URL.sub(" ", cleaned(t or "")))
                own = {xxhash.xxh64_intdigest(" ".join(words[i : i + n])) for n in range(1, LONGEST + 1) for i in range(len(words) - n + 1)}
                keys += [k] * len(own)
                hashes += [h - (1 << 63) for h in own]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(hashes, pa.int64())], [key, "h"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh64_intdigest(p) - (1 << 63) for p in batch.column(0).to_pylist()], pa.int64())], ["phrase", "h"])

    def judge_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield result(batch.column(0), [evidence(t, Phrases(o or ())) for t, o in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)])

    own = pages.mapInArrow(shingles, f"`{key}` {key_type}, h long").join(phrases.mapInArrow(hashed, "phrase string, h long"), "h")
    own = own.groupBy(key).agg(F.collect_set("phrase").alias("own"))
    return pages.join(own, key, "left").select(key, "page_text", "own").mapInArrow(judge_own, schema)


def stuffed_pages(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "site") -> DataFrame:
    """Keys of the pages that consist of keywords, links, tags or offers instead of text."""
    found = page_evidence(df, key, text, host)
    return found.where(" or ".join(f"stitched >= {s} and listed >= {d}" for s, d in FLAGS)).select(key)
