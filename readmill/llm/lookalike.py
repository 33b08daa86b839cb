"""Visually identical text with different characters: look-alike classes and their rewriting.

Strings that are drawn alike (composed and decomposed letters, full-width forms, ligatures, blanks, hyphens,
letters of other alphabets and of mathematical alphabets, invisible characters as the empty string) are nodes; union-find makes
the classes transitive, so that e.g. Cyrillic IO, Cyrillic IE + diaeresis and Latin E + diaeresis fall together.  The
representative of a class is its most frequent composed member in the corpus.  Texts are brought to canonical composition, which
also orders combining marks, and rewritten by a multi-pattern automaton, longest match first, until nothing changes.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Mapping

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readmill.functions.flat import flat
from readmill.plans.runtime import cut_lineage, written

# Letters of other alphabets drawn like a Latin letter.
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ρp ϲc ϳj ϹC ͿJ"
CYRILLIC = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ҮY ХX ԚQ ԜW ӀI ѴV аa еe оo рp сc уy үy хx ѕs іi јj һh ӏl ԁd ԛq ԝw ѵv"
ARMENIAN = "ՕO ՍU ՏS օo ոn սu հh զq յj ցg"
COPTIC = "ⲀA ⲂB ⲌZ ⲎH ⲒI ⲔK ⲘM ⲚN ⲞO ⲢP ⲤC ⲦT ⲨY ⲬX ⲟo ⲣp ⲥc"
CHEROKEE = "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᏃZ"
LISU = "ꓮA ꓐB ꓚC ꓓD ꓰE ꓝF ꓖG ꓧH ꓲI ꓙJ ꓗK ꓡL ꓟM ꓠN ꓳO ꓑP ꓣR ꓢS ꓔT ꓴU ꓦV ꓪW ꓫX ꓬY ꓜZ"
LATIN = "ɑa ɡg"
DRAWN_ALIKE = f"{GREEK} {CYRILLIC} {ARMENIAN} {COPTIC} {CHEROKEE} {LISU} {LATIN}".split()
# Blanks of other kinds or widths, hyphens, and characters that are not drawn.
BLANKS = [" ", "\u00a0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u202f", "\u205f", "\u3000"]
HYPHENS = ["-", "\u2010", "\u2011", "\ufe63", "\uff0d"]
INVISIBLE = [
    "\u00ad", "\u034f", "\u061c", "\u180e", *map(chr, range(0x200B, 0x2010)), *map(chr, range(0x202A, 0x202F)),
    *map(chr, range(0x2060, 0x2065)), *map(chr, range(0x2066, 0x2070)), *map(chr, range(0xFE00, 0xFE10)), "\ufeff",
]
#: Ranges whose compatibility decomposition only changes width or resolves a ligature.
WIDTHS_AND_LIGATURES = [(0xFB00, 0xFB07), (0xFF01, 0xFFE7)]
#: Ranges with the letters of other fonts (mathematical alphabets), and the Roman numerals that are written as letters.
FONTS, NUMERALS = [(0x2100, 0x2150), (0x1D400, 0x1D800)], (0x2160, 0x2180)
#: Ranges of letters whose composed and decomposed forms are classes.
COMPOSED = [(0x00C0, 0x0250), (0x0370, 0x0530), (0x1E00, 0x2000), (0x212A, 0x212C)]


#: Passes of rewriting after which classes that feed each other are an error; two or three are usual.
MOST_PASSES = 50


class UnionFind:
    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, x: str, y: str) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return [sorted(v) for v in out.values() if len(v) > 1]


@functools.lru_cache(1)
def look_alike_classes() -> tuple[tuple[str, ...], ...]:
    uf = UnionFind()
    for pair in DRAWN_ALIKE:
        uf.union(pair[0], pair[1])
    for lo, hi in FONTS:
        for c in map(chr, range(lo, hi)):
            kind, _, plain = unicodedata.decomposition(c).partition(" ")
            if kind == "<font>" and chr(int(plain, 16)).isalpha():
                uf.union(c, chr(int(plain, 16)))
    for c in map(chr, range(*NUMERALS)):
        uf.union(c, unicodedata.normalize("NFKC", c))
    for group in (BLANKS, HYPHENS):
        for x in group[1:]:
            uf.union(group[0], x)
    for x in INVISIBLE:
        uf.union("", x)
    for lo, hi in WIDTHS_AND_LIGATURES:
        for c in map(chr, range(lo, hi)):
            plain = unicodedata.normalize("NFKC", c)
            if plain != c and not plain.isspace():
                uf.union(c, plain)
    latin = {p[0]: p[1] for p in DRAWN_ALIKE}
    for lo, hi in COMPOSED:
        for c in map(chr, range(lo, hi)):
            parts = unicodedata.normalize("NFD", c)
            if parts == c:
                continue
            uf.union(c, parts)
            as_latin = latin.get(parts[0], parts[0]) + parts[1:]
            uf.union(c, unicodedata.normalize("NFC", as_latin))
            uf.union(c, as_latin)
            for base, like in latin.items():
                if like == parts[0]:
                    uf.union(c, base + parts[1:])
    return tuple(sorted(map(tuple, uf.classes())))


def preferred(x: str) -> tuple:
    """Order among members of equal frequency: plain letters, then composed ones, then low code points."""
    return (not x.isascii(), unicodedata.normalize("NFKC", x) != x, len(x), x)


class Rewriter:
    """Rewrites every member of a class to the class's representative."""

    def __init__(self, counts: Mapping[str, int] | None = None):
        counts = counts or {}
        to = {}
        for members in look_alike_classes():
            # texts are composed before they are searched, so only composed members can be met or stand for the class
            members = [x for x in members if unicodedata.is_normalized("NFC", x)]
            best = "" if "" in members else min(members, key=lambda x: (-counts.get(x, 0), preferred(x)))
            to |= {x: best for x in members if x != best}
        self.machine = ahocorasick.Automaton()
        for x, y in to.items():
            self.machine.add_word(x, (len(x), y))
        self.machine.make_automaton()
        # a quick look for what may be rewritten: single characters, marks that stay alone, other strings
        marks = {x[-1] for x in to if len(x) > 1 and unicodedata.combining(x[-1])}
        single = sorted({x for x in to if len(x) == 1} | marks)
        longer = sorted(x for x in to if len(x) > 1 and x[-1] not in marks)
        near, far = ([x for x in single if (x > "\uffff") is k] for k in (False, True))
        self.looks = [re.compile("|".join(["[" + "".join(map(re.escape, near)) + "]", *map(re.escape, longer)]))]
        if far:  # a class with characters of both kinds is searched one by one, a range is not
            self.looks.append(re.compile(f"[{far[0]}-{far[-1]}]"))

    def odd(self, text: str) -> bool:
        return any(x.search(text) for x in self.looks)

    def __call__(self, text: str) -> str:
        if text.isascii() and not self.rewrites_ascii:
            return text
        text = unicodedata.normalize("NFC", text)
        for _ in range(MOST_PASSES):
            if not self.odd(text):
                return text
            out, done = [], 0
            for end, (n, to) in self.machine.iter_long(text):
                out += (text[done : end + 1 - n], to)
                done = end + 1
            new = unicodedata.normalize("NFC", "".join(out) + text[done:])
            if new == text:
                return text
            text = new
        raise RuntimeError("the classes of look-alikes do not settle")

    @functools.cached_property
    def rewrites_ascii(self) -> bool:
        return self.odd("".join(map(chr, range(128))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often the members of the classes stand in a partition: single code points and marks after a letter."""
    known = {x for c in look_alike_classes() for x in c}
    single = np.zeros(0x110000, np.int64)
    double: Counter[str] = Counter()
    marks = np.array(sorted({ord(x[-1]) for x in known if len(x) > 1 and unicodedata.combining(x[-1])}), np.uint32)
    plain = [(x, x.encode()) for x in known if len(x) > 1 and not unicodedata.combining(x[-1])]
    for b in batches:
        codes, _ = flat(b.column(0))
        if not len(codes):
            continue
        whole = b"\n".join(t.as_py().encode() for t in b.column(0) if t.is_valid)
        for x, y in plain:
            double[x] += whole.count(y)
        c = np.bincount(codes)
        single[: len(c)] += c
        if codes.dtype != np.uint8:
            at = np.flatnonzero(np.isin(codes, marks))
            at = at[at > 0]
            pair, n = np.unique(codes[at - 1].astype(np.uint64) << np.uint64(32) | codes[at], return_counts=True)
            for p, k in zip(pair.tolist(), n.tolist()):
                double[chr(p >> 32) + chr(p & 0xFFFFFFFF)] += k
    rows = [(x, int(single[ord(x)]) if len(x) == 1 else double[x]) for x in known if x]
    rows = [(x, n) for x, n in rows if n]
    yield pa.RecordBatch.from_arrays(
        [pa.array([x for x, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["member", "n"]
    )


def member_counts(df: DataFrame, text_col: str) -> dict[str, int]:
    """Corpus frequency of every class member; its size is bounded by the fixed table of classes."""
    rows = df.select(text_col).mapInArrow(_counts, "member string, n long").groupBy("member").agg(F.sum("n").alias("n"))
    return {r.member: r.n for r in rows.collect()}


@functools.lru_cache(4)
def rewriter_for(items: tuple[tuple[str, int], ...]) -> Rewriter:
    return Rewriter(dict(items))


def _rewrite(items: tuple[tuple[str, int], ...], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = rewriter_for(items)
        for b in batches:
            texts = b.column(1).to_pylist()
            new = [None if t is None else fold(t) for t in texts]
            if with_text:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(new, pa.string()), pa.array([a != n for a, n in zip(texts, new)])],
                    names=["id", "text", "changed"],
                )
                continue
            there = [i for i, t in enumerate(new) if t is not None]
            key = [hashlib.blake2b(new[i].encode("utf-8", "surrogatepass"), digest_size=16).digest() for i in there]
            raw = [
                k if new[i] is texts[i] else hashlib.blake2b(texts[i].encode("utf-8", "surrogatepass"), digest_size=16).digest()
                for k, i in zip(key, there)
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(there, pa.int64())), pa.array(key, pa.binary()), pa.array(raw, pa.binary())],
                names=["id", "look", "raw"],
            )

    return run


def consistent_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, changed): every row's text in the one form of its look-alike class.

    A null text stays null and unchanged; an empty text stays empty; repeated rows are all kept; other columns
    are ignored.  Equal results mean that the texts look the same.
    """
    items = tuple(sorted(member_counts(df, text_col).items()))
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(_rewrite(items, True), "id long, text string, changed boolean")


#: A set of documents with the same text up to this size is paired member by member, a larger one as look_alike_pairs says.
LISTED = 1000


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, look, raw): two digests of every document, written once, so that every text is rewritten a single time."""
    items = tuple(sorted(member_counts(df, text_col).items()))
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull())
    return written(src.mapInArrow(_rewrite(items, False), "id long, look binary, raw binary"))


def look_alike_pairs(df: DataFrame, id_col: str, text_col: str, listed: int = LISTED) -> DataFrame:
    """(a, b), a < b: pairs of ids whose texts are not identical but look identical.

    Rows with a null id or text take no part; rows that repeat an id and text count once.  Two wordings of at most
    `listed` documents each are paired member by member.  Otherwise every document of either one is paired with the
    smallest id of the other, so that the rows grow with the documents and none of them is lost.
    """
    keyed = _keyed(df, id_col, text_col).distinct()
    variants = keyed.groupBy("look", "raw").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    several = variants.groupBy("look").agg(F.min("raw").alias("_lo"), F.max("raw").alias("_hi")).filter("_lo < _hi").select("look")
    some = cut_lineage(variants.join(several.hint("merge"), "look", "left_semi"))
    documents = cut_lineage(keyed.join(some.hint("merge"), ["look", "raw"]).select("look", "raw", "id", "n"))
    small = documents.filter(F.col("n") <= listed)
    inner = (
        small.alias("x")
        .join(small.alias("y").hint("merge"), F.expr("x.look = y.look and x.raw <> y.raw and x.id < y.id"))
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    )
    # only classes with a large wording: its documents and those of the other wordings go with each other's smallest ids
    large = some.filter(F.col("n") > listed).select("look").distinct()
    outer = (
        documents.join(large.hint("merge"), "look", "left_semi").alias("x")
        .join(some.alias("y").hint("merge"), F.expr(f"x.look = y.look and x.raw <> y.raw and (x.n > {listed} or y.n > {listed})"))
        .select(F.least("x.id", "y.rep").alias("a"), F.greatest("x.id", "y.rep").alias("b"))
        .filter("a < b")
    )
    return inner.unionByName(outer).distinct()


def look_alike_members(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, wording, look_class): every document with an id and text; the smallest id of its wording and of its look-alike class."""
    keyed = _keyed(df, id_col, text_col).distinct()
    wording = keyed.groupBy("look", "raw").agg(F.min("id").alias("wording"))
    look = wording.groupBy("look").agg(F.min("wording").alias("look_class"))
    return (
        keyed.join(wording.hint("merge"), ["look", "raw"]).join(look.hint("merge"), "look").select("id", "wording", "look_class")
    )
