"""Quality rules: word, symbol and repetition counts, then distribution divergence from language references.

A document's character classes and common words are compared with those of each language's reference by
Jensen-Shannon distance; the nearest reference counts. A reference is the mean histogram of the documents in that language: those
that pass the base rules and of whose words a tenth are common words of the language, by the fixed lists. So neither junk, however
much of it there is, nor single long documents make a reference, and no label of a language is needed.

Texts are measured once: a stored table holds each document's measures, from which references and verdicts are taken. No shuffle but
the sum of the references, which have a fixed size. One Arrow batch (bounded in bytes) is in a worker's memory at a time.

Defined cases: null or empty text: no words, base_failed. Very long texts are measured whole. A distance of a text too short for it
(``MIN_WORDS``, ``MIN_CHARS``) doesn't count; without any document in a reference language none does. References of few words allow for larger
distances, as short texts do. Of references at one distance, the first of ``COMMON`` counts. Repeated rows and null ids give a row
each. Other columns, whatever their names, come back from keep() as they were. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, small_batches, store

# Common words of the reference languages.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years much where your way down should because long each just state those people too".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei wenn kann ich unter wir ihre mir uns ihm was da doch keine dann schon".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec ou son aux mais comme on tout nous sa fait été aussi leur bien peut ces y deux cette même elle si entre sans très".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde".split(),
}
#: Shorter texts' histograms of common words, and of character classes, say nothing.
MIN_WORDS, MIN_CHARS = 30, 100
#: The least share of common words of a language in a document of its reference.
ANCHOR = 0.1
#: Largest distances to the nearest reference: of the character classes, of the common words, and of both added up.
#: Each is (for endless texts, what noise adds): short texts and small references stray by chance, by one over the root of their words.
CLASSES_AT, WORDS_AT, SUM_AT = (0.24, 0.6), (0.27, 0.8), (0.38, 1.0)

CLASSES = ("lower", "upper", "digit", "blank", "newline", "stop", "symbol", "other", "beyond")


def _class_table() -> np.ndarray:
    """256 byte values by class; bytes that only go on a character have none (-1)."""
    t = np.full(256, CLASSES.index("other"))
    for b in range(256):
        c = chr(b)
        if 0x80 <= b < 0xC0:
            t[b] = -1
        elif b >= 0xC0:
            t[b] = CLASSES.index("beyond")
        elif c.islower() or c.isupper():
            t[b] = CLASSES.index("lower" if c.islower() else "upper")
        elif c.isdigit():
            t[b] = CLASSES.index("digit")
        elif c == "\n":
            t[b] = CLASSES.index("newline")
        elif c in " \t\x0b\x0c\r":
            t[b] = CLASSES.index("blank")
        elif c in ".,;:?'\"()-":
            t[b] = CLASSES.index("stop")
        elif c in "#*$%&|<>":
            t[b] = CLASSES.index("symbol")
    return t


_CLASS = _class_table()
_TO_CLASS = np.stack([(_CLASS == k) for k in range(len(CLASSES))], axis=1).astype(np.int64)
_BLANKS = np.array([9, 10, 11, 12, 13, 32])
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_VOCABULARY = {w.encode(): i + 1 for i, w in enumerate(dict.fromkeys(w for ws in COMMON.values() for w in ws))}
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], size: int = 8) -> int:
    """Words in windows of ``size`` words that the text holds twice or more."""
    n = len(words)
    if n <= size:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    step, mix = 1, _MIX
    with np.errstate(over="ignore"):
        while step < size:  # windows of 1, 2, 4, 8 words
            h = h[:-step] * mix + (h[step:] ^ (h[step:] >> np.uint64(29)))
            mix, step = mix * mix, 2 * step
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    starts = np.isin(h, twice)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, np.flatnonzero(starts), 1)
    np.add.at(cover, np.flatnonzero(starts) + size, -1)
    return int((np.cumsum(cover)[:n] > 0).sum())


def measure(text: bytes | None) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), the character classes, the common words (0: others)."""
    text = text or b""
    words = text.split()
    raw = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line in seen and line.split(None, 1):
            dup += 1
        seen.add(line)
    get = _VOCABULARY.get
    common = np.bincount(np.fromiter((get(w, 0) for w in words), np.int64, len(words)), minlength=len(_VOCABULARY) + 1)
    base = [len(words), int(raw.sum() - raw[0x80:0xC0].sum() - raw[_BLANKS].sum()), int(raw[_SYMBOLS].sum()), dup, repeated_words(words)]
    return base, raw @ _TO_CLASS, common


def failed(base: list[int]) -> bool:
    return base[0] < 20 or 100 * base[4] > 30 * base[0]


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms; 0 if either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, kl / 2)))


MEASURED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, histograms binary"
_BASE = [c.split()[0] for c in MEASURED.split(", ")[:-1]]
_WIDTH = len(CLASSES) + len(_VOCABULARY) + 1


def _packed(classes: np.ndarray, common: np.ndarray) -> bytes:
    """The non-zero slots of both histograms."""
    h = np.concatenate([classes, common])
    at = np.flatnonzero(h)
    return at.astype("<u2").tobytes() + h[at].astype("<i8").tobytes()


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 10
    h = np.zeros(_WIDTH, np.int64)
    h[np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<i8", n, 2 * n)
    return h[: len(CLASSES)], h[len(CLASSES) :]


def measures(text: Column) -> Column:
    """A struct of MEASURED for each text (as bytes)."""

    @F.pandas_udf(MEASURED)
    def measured(texts: pd.Series) -> pd.DataFrame:
        rows = [(*base, _packed(*hist)) for base, *hist in map(measure, texts)]
        return pd.DataFrame(rows, columns=[*_BASE, "histograms"])

    return measured(F.coalesce(text, F.lit("")).cast("binary"))


def references(measured: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, float]]:
    """Character-class and common-word shares of each reference language, and the number of words they rest on. measured: a struct ``m`` of MEASURED."""
    own = {k: np.array(sorted({_VOCABULARY[w.encode()] for w in ws})) for k, ws in COMMON.items()}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # shares in fixed point, so that sums are the same in any order
        total = {k: np.zeros(_WIDTH, np.int64) for k in COMMON}
        seen = {k: np.zeros(2, np.int64) for k in COMMON}
        for b in batches:
            for m in b.column("m").to_pylist():
                if failed([m[k] for k in _BASE]):
                    continue
                classes, common = _unpacked(m["histograms"])
                share = {k: common[at].sum() / common.sum() for k, at in own.items()}
                lang = max(share, key=share.get)
                if share[lang] >= ANCHOR:
                    total[lang] += np.concatenate([np.rint(classes / classes.sum() * (1 << 30)), np.rint(common / common.sum() * (1 << 30))]).astype(np.int64)
                    seen[lang] += [1, m["n_words"]]
        found = [(k, i, int(v)) for k, t in total.items() for i, v in enumerate([*t, *seen[k]]) if v]
        yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], t) for j, t in enumerate((pa.string(), pa.int32(), pa.int64()))], ["lang", "slot", "n"])

    # bounded: a number for each language and slot
    rows = measured.select("m").mapInArrow(sums, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
    out = {}
    for lang in COMMON:
        h = np.zeros(_WIDTH + 2)
        for r in rows:
            if r.lang == lang:
                h[r.slot] = float(r.n)
        if h[_WIDTH]:
            out[lang] = h[: len(CLASSES)], h[len(CLASSES) : _WIDTH], h[_WIDTH + 1]
    return out


def divergence(classes: np.ndarray, common: np.ndarray, refs: dict) -> tuple[float, float, str | None]:
    """Distances of the classes and of the common words from the nearest reference, and its language."""
    best = (0.0, 0.0, None)
    for lang, (c, w, _) in refs.items():
        got = js_distance(classes, c), js_distance(common, w), lang
        if best[2] is None or got[0] + got[1] < best[0] + best[1]:
            best = got
    return best


def keeps(classes: np.ndarray, common: np.ndarray, refs: dict) -> tuple[bool, float, float, str | None]:
    """The verdict on a document's histograms, its distances and the reference they are from."""
    by_class, by_word, lang = divergence(classes, common, refs)
    if lang is None:
        return True, by_class, by_word, lang
    words = int(common.sum())
    noise = (1 / max(1, words) + 1 / refs[lang][2]) ** 0.5
    told = [(by_class, CLASSES_AT)] if classes.sum() >= MIN_CHARS else []
    told += [(by_word, WORDS_AT)] if words >= MIN_WORDS else []
    told += [(by_class + by_word, SUM_AT)] if len(told) == 2 else []
    return all(d <= far + noise * near for d, (far, near) in told), by_class, by_word, lang


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double, reference string"
JUDGED = "base_failed boolean, kept boolean, class_distance double, word_distance double, reference string"


def verdicts(m: Column, refs: dict) -> Column:
    """A struct of JUDGED for each struct of MEASURED."""

    @F.pandas_udf(JUDGED)
    def judged(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for base, raw in zip(rows[_BASE].itertuples(index=False), rows["histograms"], strict=True):
            bad = failed(base)
            kept, *told = keeps(*_unpacked(raw), refs)
            out.append((bad, kept and not bad, *told))
        return pd.DataFrame(out, columns=[c.split()[0] for c in JUDGED.split(", ")])

    return judged(m)


def score(docs: DataFrame, refs: dict | None = None) -> DataFrame:
    """A row of SCHEMA for each document. refs: of references(), else those of these documents."""
    small_batches(docs.sparkSession)
    measured, _ = store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), measures(F.col("text")).alias("m")), "measures")
    refs = references(measured) if refs is None else refs
    judged = measured.withColumn("v", verdicts(F.col("m"), refs))
    return judged.select("doc_id", *[f"m.{c}" for c in _BASE], "v.*")


def keep(docs: DataFrame, refs: dict | None = None) -> DataFrame:
    """The documents that the rules keep, with all their columns: one pass over the texts, then one over stored documents; no join."""
    small_batches(docs.sparkSession)
    (m,) = free_names(docs.columns, "_sl_measures")
    stored, _ = store(docs.withColumn(m, measures(F.col("text"))), "measured-documents")
    refs = references(stored.select(F.col(m).alias("m"))) if refs is None else refs
    return stored.where(verdicts(F.col(m), refs)["kept"]).select(*docs.columns)
